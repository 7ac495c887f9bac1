"""The batch plan: events to sessions, features, labels and automation profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features, labels, sessions


def session_intelligence(events: DataFrame, gap_seconds: float = sessions.GAP_SECONDS) -> DataFrame:
    """One row for each session with all that is known of it."""
    built = sessions.build_sessions(events, gap_seconds)
    return labels.standard_labels(labels.automation_profile(labels.attack_labels(features.session_features(built))))
