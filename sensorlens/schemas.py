"""Schemas of events, exports and corpora, as DDL text."""

#: A normalised event of any sensor.
EVENT = (
    "version int, log_source string, timestamp timestamp, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, "
    "protocol string, session_id string, username string, password string, request_data string, dns_query string, http_method string, "
    "http_uri string, http_user_agent string, alert_type string, severity int, raw string"
)
VERSION = 1
REQUIRED = ["version", "log_source", "timestamp", "event_type", "src_ip"]
#: The event table has a number for each row, used to break ties between equal timestamps.
EVENT_TABLE = "id long, " + EVENT
GENERATED_EVENT_TABLE = EVENT_TABLE + ", generation_model string"
TEXT_COLUMNS = [c.split()[0] for c in EVENT.split(", ") if c.endswith(" string")]
FLAT_EXPORT = "source_cowrie int, event_type string, session_id string, session_duration double, request_data string, raw string"
CORPUS = "instruction string, output string"
EVALUATION = "sample_id long, condition string, instruction string, reference string, hypothesis string, precision double, recall double, f1 double"
GEO = "query string, country string, lat double, lon double, org string, count long"

#: Features of a session that a model may see, those that labels are made from, and the labels.
SAFE_FEATURES = [
    "duration_sec", "event_count", "min_inter_cmd_delay", "max_inter_cmd_delay", "cmd_count", "cmd_unique_count", "cmd_entropy", "cmd_avg_length", "cmd_max_length",
    "port_range_span", "has_sensitive_ports", "protocol_count", "dns_query_count", "dns_avg_query_length", "http_unique_uris", "unique_usernames", "password_entropy_avg",
    "payload_entropy_avg", "payload_entropy_max", "avg_payload_length", "avg_cmd_per_event", "log_duration", "log_event_count", "entropy_ratio",
]
HEURISTIC_FEATURES = [
    "has_download_execute_chain", "has_reverse_shell", "has_base64_decode", "has_recon_commands", "has_persistence", "has_file_exfiltration", "has_destructive",
    "has_downloader", "has_sql_injection", "has_path_traversal", "has_cmd_injection", "has_internal_ip_scan", "has_port_forwarding", "has_encoded_payloads",
    "tls_on_non_standard_port", "dns_tunnel_indicator", "has_default_creds", "automation_score", "timing_variance_ratio", "events_per_minute", "cmd_unique_ratio",
    "burst_count", "unique_dest_ports", "unique_passwords", "credential_retry_count", "credential_attempts", "avg_inter_cmd_delay", "std_inter_cmd_delay",
]
LABELS = [
    "label_brute_force", "label_malware_dropper", "label_tunneling", "label_lateral_movement", "label_reconnaissance", "label_data_exfiltration", "label_destructive",
    "label_port_scan", "label_credential_spray", "label_service_interaction", "label_network_probe",
]


def existing(wanted: list[str], columns: list[str]) -> list[str]:
    """Those of ``wanted`` that there are, in order."""
    return [c for c in wanted if c in columns]
