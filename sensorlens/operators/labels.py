"""Rule labels and the automation profile of sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS


def _yes(name: str) -> Column:
    return F.col(name) == 1


def attack_labels(s: DataFrame) -> DataFrame:
    """Eleven labels of 0 or 1, their names joined by '|', and their number. Missing features count as 0."""
    needed = ["cmd_count", "credential_attempts", "unique_passwords", "has_download_execute_chain", "has_downloader", "has_persistence", "has_port_forwarding", "tls_on_non_standard_port", "dns_tunnel_indicator", "has_internal_ip_scan", "has_recon_commands", "has_file_exfiltration", "has_destructive", "unique_dest_ports"]
    s = s.withColumns({c: F.lit(0) for c in needed if c not in s.columns})
    rules = {
        "label_brute_force": (F.col("credential_attempts") >= 3) & (F.col("unique_passwords") >= 2),
        "label_malware_dropper": _yes("has_download_execute_chain") | (_yes("has_downloader") & _yes("has_persistence")),
        "label_tunneling": _yes("has_port_forwarding") | _yes("tls_on_non_standard_port") | _yes("dns_tunnel_indicator"),
        "label_lateral_movement": _yes("has_internal_ip_scan") | (_yes("has_port_forwarding") & _yes("has_recon_commands")),
        "label_reconnaissance": _yes("has_recon_commands"),
        "label_data_exfiltration": _yes("has_file_exfiltration"),
        "label_destructive": _yes("has_destructive"),
    }
    specific = list(rules)
    s = s.withColumns({k: v.cast("int") for k, v in rules.items()})
    s = s.withColumns({"label_port_scan": (F.col("unique_dest_ports") >= 3).cast("int"), "label_credential_spray": ((F.col("credential_attempts") >= 1) & (F.col("label_brute_force") == 0)).cast("int")})
    none = lambda names: reduce(lambda a, b: a & b, [F.col(n) == 0 for n in names])
    s = s.withColumn("label_service_interaction", ((F.col("cmd_count") > 0) & none(specific)).cast("int"))
    s = s.withColumn("label_network_probe", none([n for n in LABELS if n != "label_network_probe"]).cast("int"))
    named = [F.when(_yes(n), n.removeprefix("label_")) for n in LABELS]
    return s.withColumns({"attack_labels": F.concat_ws("|", *named), "attack_label_count": reduce(lambda a, b: a + b, [F.col(n) for n in LABELS])})


def automation_score(variance_ratio: Column, per_minute: Column, unique_ratio: Column, bursts: Column) -> Column:
    clip = lambda c, high: F.least(F.greatest(c, F.lit(0.0)), F.lit(high))
    rate = F.when(per_minute > 20, 0.2).when(per_minute > 5, 0.1).otherwise(0.0)
    score = F.lit(0.5) - clip(variance_ratio * 0.2, 0.2) + rate - clip(unique_ratio * 0.2, 0.2) + F.when(bursts > 3, 0.1).otherwise(0.0)
    return F.bround(clip(score, 1.0), 2)


def automation_profile(s: DataFrame) -> DataFrame:
    score = automation_score(F.col("timing_variance_ratio"), F.col("events_per_minute"), F.col("cmd_unique_ratio"), F.col("burst_count"))
    kind = F.when(F.col("automation_score") >= 0.7, "scripted").when(F.col("automation_score") <= 0.3, "manual").otherwise("mixed")
    return s.withColumn("automation_score", score).withColumn("automation_likelihood", kind)


def standard_labels(s: DataFrame) -> DataFrame:
    """Labels for training: bot, tunnel, any attack, and the shorter name of brute force beside the long one."""
    attacks = [n for n in LABELS if n in s.columns]
    return s.withColumns(
        {
            "label_bruteforce": F.col("label_brute_force"), "bot_label": (F.col("automation_likelihood") != "manual").cast("int"), "tunnel_label": F.col("label_tunneling"),
            "attack_any": F.greatest(*attacks),
        }
    )
