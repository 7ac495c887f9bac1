"""SQL of ``session_intelligence``: every feature, label and profile of a session."""

from __future__ import annotations

from ..schemas import LABELS
from .stated import CREDENTIALS, FLAGS, HEX, PORTS, TLS


def _flag(name: str) -> str:
    pattern, case = FLAGS[name]
    return f"regexp_matches(j, '{'' if case else '(?i)'}{pattern}')::BIGINT AS {name}"


def intelligence_sql(sessions: str) -> str:
    """``sessions``: SQL with ``s``, events with their session, and ``r``, delays and rates by session."""
    labels = ", ".join(LABELS)
    return (
        sessions
        + f""", cm AS (SELECT session, coalesce(request_data, '') AS v, min(timestamp) AS t, arg_min(id, (timestamp, id)) AS i FROM s GROUP BY ALL),
cj AS (SELECT session, string_agg(v, '|' ORDER BY t, i) AS j FROM cm GROUP BY session),
pt AS (SELECT session, j, list_filter(string_split(j, '|'), lambda x: x <> '') AS parts FROM cj),
li AS (SELECT session, coalesce(list(DISTINCT username) FILTER (username <> ''), []) AS users, coalesce(list(DISTINCT password) FILTER (password <> ''), []) AS passwords, coalesce(list(DISTINCT dest_port) FILTER (dest_port IS NOT NULL), []) AS ports,
  count(DISTINCT protocol) FILTER (protocol <> '') AS protocols, coalesce(list(DISTINCT dns_query) FILTER (dns_query <> ''), []) AS dns, count(DISTINCT http_uri) FILTER (http_uri <> '') AS uris, list(DISTINCT event_type) AS kinds, count(*) FILTER (regexp_matches(lower(event_type), 'login|auth|connect')) AS login_event_count FROM s GROUP BY session),
md AS (SELECT session, log_source FROM (SELECT session, log_source, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, log_source) AS k FROM s GROUP BY session, log_source) WHERE k = 1),
f1 AS (SELECT session, j, len(parts) AS cmd_count, len(list_distinct(parts)) AS cmd_unique_count, list_entropy(parts) AS cmd_entropy, coalesce(list_avg(list_transform(parts, lambda x: length(x))), 0) AS cmd_avg_length, coalesce(list_max(list_transform(parts, lambda x: length(x))), 0) AS cmd_max_length,
  coalesce(list_avg(list_transform(parts, lambda x: list_entropy(string_split(x, '')))), 0) AS payload_entropy_avg, coalesce(list_max(list_transform(parts, lambda x: list_entropy(string_split(x, '')))), 0) AS payload_entropy_max,
  {", ".join(_flag(n) for n in FLAGS)}, regexp_matches(j, '{HEX}')::BIGINT AS hex, regexp_matches(j, '(?i){TLS}') AS tls FROM pt),
f2 AS (SELECT session, login_event_count, len(ports) AS unique_dest_ports, CASE WHEN len(ports) >= 2 THEN list_max(ports) - list_min(ports) ELSE 0 END AS port_range_span, list_has_any(ports, [{PORTS}])::BIGINT AS has_sensitive_ports, len(list_filter(ports, lambda p: p <> 443)) > 0 AS odd_port,
  protocols AS protocol_count, len(dns) AS dns_query_count, coalesce(list_avg(list_transform(dns, lambda q: length(q))), 0) AS dns_avg_query_length, (len(list_filter(dns, lambda q: length(q) > 50 OR length(q) - length(replace(q, '.', '')) > 4)) > 0)::BIGINT AS dns_tunnel_indicator, uris AS http_unique_uris,
  list_sum(list_transform(kinds, lambda k: len(regexp_extract_all(lower(k), 'login|auth|connect')))) AS credential_attempts, len(users) AS unique_usernames, len(passwords) AS unique_passwords, coalesce(list_avg(list_transform(passwords, lambda p: list_entropy(string_split(p, '')))), 0) AS password_entropy_avg,
  list_has_any(flatten(list_transform(users, lambda u: list_transform(passwords, lambda p: lower(u) || ':' || lower(p)))), [{CREDENTIALS}])::BIGINT AS has_default_creds FROM li),
f3 AS (SELECT *, CASE WHEN cmd_count > 0 THEN cmd_unique_count / cmd_count ELSE 0 END AS cmd_unique_ratio, greatest(has_base64_decode, hex) AS has_encoded_payloads, (tls AND odd_port)::BIGINT AS tls_on_non_standard_port FROM f1 JOIN f2 USING (session) JOIN r USING (session) JOIN md USING (session)),
b1 AS (SELECT *, (credential_attempts >= 3 AND unique_passwords >= 2)::BIGINT AS label_brute_force, (has_download_execute_chain = 1 OR (has_downloader = 1 AND has_persistence = 1))::BIGINT AS label_malware_dropper, (has_port_forwarding = 1 OR tls_on_non_standard_port = 1 OR dns_tunnel_indicator = 1)::BIGINT AS label_tunneling,
  (has_internal_ip_scan = 1 OR (has_port_forwarding = 1 AND has_recon_commands = 1))::BIGINT AS label_lateral_movement, has_recon_commands AS label_reconnaissance, has_file_exfiltration AS label_data_exfiltration, has_destructive AS label_destructive, (unique_dest_ports >= 3)::BIGINT AS label_port_scan FROM f3),
b2 AS (SELECT *, (credential_attempts >= 1 AND label_brute_force = 0)::BIGINT AS label_credential_spray, (cmd_count > 0 AND label_brute_force + label_malware_dropper + label_tunneling + label_lateral_movement + label_reconnaissance + label_data_exfiltration + label_destructive = 0)::BIGINT AS label_service_interaction FROM b1),
b3 AS (SELECT *, (label_brute_force + label_malware_dropper + label_tunneling + label_lateral_movement + label_reconnaissance + label_data_exfiltration + label_destructive + label_port_scan + label_credential_spray + label_service_interaction = 0)::BIGINT AS label_network_probe FROM b2),
b4 AS (SELECT *, round_even(least(greatest(0.5::DOUBLE - least(greatest(variance * 0.2::DOUBLE, 0), 0.2::DOUBLE) + CASE WHEN per_minute > 20 THEN 0.2::DOUBLE WHEN per_minute > 5 THEN 0.1::DOUBLE ELSE 0 END - least(greatest(cmd_unique_ratio * 0.2::DOUBLE, 0), 0.2::DOUBLE) + CASE WHEN bursts > 3 THEN 0.1::DOUBLE ELSE 0 END, 0), 1), 2)::DOUBLE AS automation_score FROM b3)
SELECT session, log_source, cmd_count, cmd_unique_count, round(cmd_unique_ratio, 6) AS cmd_unique_ratio, round(cmd_entropy, 6) + 0.0 AS cmd_entropy, round(cmd_avg_length, 6) AS cmd_avg_length, cmd_max_length::BIGINT AS cmd_max_length, {", ".join(FLAGS)}, has_encoded_payloads, round(payload_entropy_avg, 6) + 0.0 AS payload_entropy_avg, round(payload_entropy_max, 6) + 0.0 AS payload_entropy_max,
 round(cmd_avg_length, 6) AS avg_payload_length, round(variance, 6) AS timing_variance_ratio, round(per_minute, 6) AS events_per_minute, unique_dest_ports, port_range_span::BIGINT AS port_range_span, has_sensitive_ports, protocol_count, dns_query_count, round(dns_avg_query_length, 6) AS dns_avg_query_length, http_unique_uris, tls_on_non_standard_port, dns_tunnel_indicator,
 credential_attempts::BIGINT AS credential_attempts, login_event_count, unique_usernames, unique_passwords, unique_passwords AS credential_retry_count, has_default_creds, round(password_entropy_avg, 6) + 0.0 AS password_entropy_avg, round(cmd_count / events, 6) AS avg_cmd_per_event, round(ln(1 + duration), 6) AS log_duration, round(ln(1 + events), 6) AS log_event_count,
 round(CASE WHEN payload_entropy_avg > 0 THEN cmd_entropy / payload_entropy_avg ELSE 0 END, 6) + 0.0 AS entropy_ratio, {labels}, concat_ws('|', {", ".join(f"CASE WHEN {n} = 1 THEN '{n.removeprefix('label_')}' END" for n in LABELS)}) AS attack_labels, {" + ".join(LABELS)} AS attack_label_count,
 round(automation_score, 6) AS automation_score, CASE WHEN automation_score >= 0.7 THEN 'scripted' WHEN automation_score <= 0.3 THEN 'manual' ELSE 'mixed' END AS automation_likelihood, label_brute_force AS label_bruteforce, (automation_score > 0.3)::BIGINT AS bot_label, label_tunneling AS tunnel_label, greatest({labels}) AS attack_any FROM b4"""
    )
