"""Behavioural features of sessions, as expressions over their lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import net, text as T


def command_features(s: DataFrame, split_pipes: bool = True, per_command: bool = False) -> DataFrame:
    """Counts, lengths, entropy and pattern flags of ``commands``. ``split_pipes``: a pipe inside a command parts it.

    Flags look at the commands joined by pipes, as published figures do, so that chains over several commands are found and
    patterns with a pipe fire between commands; with ``per_command`` at each command by itself.
    """
    found = lambda pattern, case: F.exists("commands", lambda c: T.flag(c, pattern, case) == 1).cast("int") if per_command else T.flag(F.col("_joined"), pattern, case)
    joined = F.array_join("commands", "|")
    out = s.withColumn("_joined", joined)
    parts = F.filter(F.split("_joined", r"[|]") if split_pipes else F.col("commands"), lambda x: x != "")
    out = out.withColumn("_parts", parts)
    n, unique = F.size("_parts"), F.size(F.array_distinct("_parts"))
    lengths = F.transform("_parts", F.length)
    out = out.withColumns(
        {
            "cmd_count": n, "cmd_unique_count": unique, "cmd_unique_ratio": T.ratio(unique, n), "cmd_entropy": T.list_entropy(F.col("_parts")),
            "cmd_avg_length": T.mean_of(lengths), "cmd_max_length": T.max_of(lengths),
        }
    )
    out = out.withColumns({name: found(pattern, case) for name, (pattern, case) in T.COMMAND_FLAGS.items()})
    entropies = F.transform("_parts", T.char_entropy)
    return out.withColumns(
        {
            "has_encoded_payloads": F.greatest("has_base64_decode", found(T.HEX_RUN, True)),
            "payload_entropy_avg": T.mean_of(entropies), "payload_entropy_max": F.coalesce(F.array_max(entropies), F.lit(0.0)), "avg_payload_length": T.mean_of(lengths),
            "_tls": found(T.TLS_HINT, False),
        }
    ).drop("_parts", "_joined")


def timing_features(s: DataFrame) -> DataFrame:
    """Variance ratio and events a minute; a session of no length counts its events."""
    per_minute = F.when(F.col("duration_sec") > 0, F.col("event_count") / (F.col("duration_sec") / 60)).otherwise(F.col("event_count").cast("double"))
    return s.withColumns({"timing_variance_ratio": T.ratio(F.col("std_inter_cmd_delay"), F.col("avg_inter_cmd_delay")), "events_per_minute": per_minute})


def network_features(s: DataFrame) -> DataFrame:
    ports = F.filter(F.transform("dest_ports", lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    s = s.withColumn("_ports", ports)
    span = F.when(F.size("_ports") >= 2, F.array_max("_ports") - F.array_min("_ports")).otherwise(0)
    lengths = F.transform("dns_queries", F.length)
    long_query = F.exists("dns_queries", lambda q: (F.length(q) > 50) | (F.length(q) - F.length(F.replace(q, F.lit("."), F.lit(""))) > 4))
    return s.withColumns(
        {
            "unique_dest_ports": F.size("dest_ports"), "port_range_span": span, "has_sensitive_ports": F.arrays_overlap("_ports", F.array(*map(F.lit, net.SENSITIVE_PORTS))).cast("int"),
            "protocol_count": F.size("protocols"), "dns_query_count": F.size("dns_queries"), "dns_avg_query_length": T.mean_of(lengths), "http_unique_uris": F.size("http_uris"),
            "tls_on_non_standard_port": F.when((F.col("_tls") == 1) & F.exists("_ports", lambda p: p != 443), 1).otherwise(0), "dns_tunnel_indicator": long_query.cast("int"),
        }
    ).drop("_ports", "_tls")


def credential_features(s: DataFrame) -> DataFrame:
    """Attempts are counted over the different event types, joined, as published figures do; ``login_event_count`` of
    ``build_sessions`` counts the events themselves."""
    kinds = F.lower(F.array_join("event_types", "|"))
    return s.withColumns(
        {
            "credential_attempts": F.regexp_count(kinds, F.lit("login|auth|connect")), "unique_usernames": F.size("usernames"), "unique_passwords": F.size("passwords"),
            "credential_retry_count": F.size("passwords"), "has_default_creds": net.default_credentials(F.col("usernames"), F.col("passwords")),
            "password_entropy_avg": T.mean_of(F.transform("passwords", T.char_entropy)),
        }
    )


def derived_features(s: DataFrame) -> DataFrame:
    return s.withColumns(
        {
            "avg_cmd_per_event": T.ratio(F.col("cmd_count"), F.col("event_count")), "log_duration": F.log1p(F.greatest("duration_sec", F.lit(0.0))),
            "log_event_count": F.log1p(F.col("event_count").cast("double")), "entropy_ratio": T.ratio(F.col("cmd_entropy"), F.col("payload_entropy_avg")),
        }
    )


def session_features(sessions: DataFrame, split_pipes: bool = True, per_command: bool = False) -> DataFrame:
    """``sessions`` (as ``build_sessions`` gives them) with all features."""
    empty = F.array().cast("array<string>")
    lists = ["commands", "event_types", "usernames", "passwords", "dest_ports", "protocols", "dns_queries", "http_uris"]
    full = sessions.withColumns({c: empty for c in lists if c not in sessions.columns})
    return derived_features(credential_features(network_features(timing_features(command_features(full, split_pipes, per_command)))))
