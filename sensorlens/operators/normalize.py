"""Raw sensor records, one JSON text each, to normalised events.

Each normaliser takes a column of JSON text, reads paths of the variant it parses to, and gives the columns of an event.
Text that is no JSON object gives no row; a field of another type than expected is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import EVENT, REQUIRED, VERSION

#: Event ids of the SSH sensor and the types they stand for.
SSH_EVENT_TYPES = {
    "cowrie.login.failed": "ssh_login_failed",
    "cowrie.login.success": "ssh_login_success",
    "cowrie.client.fingerprint": "ssh_publickey_attempt",
    "cowrie.session.connect": "ssh_connect",
    "cowrie.session.closed": "ssh_disconnect",
    "cowrie.session.params": "ssh_session_parameters",
    "cowrie.command.input": "ssh_command",
    "cowrie.command.failed": "ssh_command_failed",
    "cowrie.session.file_upload": "ssh_file_uploaded",
    "cowrie.session.file_download": "ssh_file_downloaded",
    "cowrie.virustotal.scanfile": "malware_virustotal_scan",
    "cowrie.client.version": "ssh_client_version",
    "cowrie.client.kex": "ssh_key_exchange",
    "cowrie.client.size": "ssh_terminal_resize",
    "cowrie.direct-tcpip.request": "ssh_port_forward_request",
    "cowrie.direct-tcpip.data": "ssh_port_forward_data",
    "cowrie.log.closed": "ssh_tty_log_closed",
    "cowrie.client.var": "ssh_env_variable",
    "cowrie.direct-tcpip.ja4": "ssh_direct_tcpip_ja4_fingerprint",
    "cowrie.direct-tcpip.ja4h": "ssh_direct_tcpip_ja4_fingerprint_hashed",
}
TYPES = {c.split()[0]: c.split()[1] for c in EVENT.split(", ")}


def get(path: str, kind: str = "string") -> Column:
    """A value of the parsed record; keys with dots are quoted in ``path``."""
    return F.try_variant_get("_v", path, kind)


def first_of(*paths: str, otherwise: Column | None = None) -> Column:
    """The first that is neither null nor empty."""
    found = [F.nullif(get(p), F.lit("")) for p in paths]
    return F.coalesce(*found, *([] if otherwise is None else [otherwise]))


def first_number(*paths: str, otherwise: int | None = None) -> Column:
    """The first that is neither null, 0 nor text that is no number."""
    found = [F.nullif(get(p).try_cast("int"), F.lit(0)) for p in paths]
    return F.coalesce(*found, F.lit(otherwise).cast("int"))


def nested(path: str) -> Column:
    """The value under the dotted key itself, else the one along its parts."""
    return F.coalesce(get(f'$["{path}"]'), get("$." + path))


def parsed_time(text: Column) -> Column:
    """A timestamp from ISO text in one of the forms that sensors write; null if it is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def _objects(raw: DataFrame, text: str) -> DataFrame:
    trimmed = raw.select(F.col(text).alias("raw")).where(F.trim("raw") != "")
    parsed = trimmed.withColumn("_v", F.try_parse_json("raw"))
    return parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))


def _event(rows: DataFrame, log_source: str, columns: dict[str, Column]) -> DataFrame:
    full = {"version": F.lit(VERSION), "log_source": F.lit(log_source), "raw": F.col("raw"), **columns}
    return rows.select(*(full.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in TYPES.items()))


def ssh_event_type(eventid: Column, strip_prefix: bool = False) -> Column:
    """The type of an event id; of one that isn't known 'unknown', or with ``strip_prefix`` the id without the sensor's name."""
    names = F.create_map(*(F.lit(x) for kv in SSH_EVENT_TYPES.items() for x in kv))
    rest = F.nullif(F.regexp_replace(eventid, r"^cowrie\.", ""), F.lit(""))
    return F.coalesce(names[eventid], *([rest] if strip_prefix else []), F.lit("unknown"))


def normalize_ssh(raw: DataFrame, text: str = "value", sensor_ip: str | None = None, strip_prefix: bool = False) -> DataFrame:
    return _event(
        _objects(raw, text),
        "cowrie",
        {
            "timestamp": parsed_time(get("$.timestamp")),
            "event_type": ssh_event_type(get("$.eventid"), strip_prefix),
            "src_ip": first_of("$.src_ip", "$.src_host", "$.peer_ip"),
            "src_port": first_number("$.src_port", "$.peer_port"),
            "dest_ip": first_of("$.dst_ip", "$.dest_ip", otherwise=F.lit(sensor_ip).cast("string")),
            "dest_port": first_number("$.dst_port", "$.dest_port", otherwise=22),
            "protocol": first_of("$.protocol", otherwise=F.lit("ssh")),
            "session_id": get("$.session"),
            "username": get("$.username"),
            "password": get("$.password"),
            "request_data": first_of("$.input", "$.message", "$.command"),
        },
    )


def normalize_service(raw: DataFrame, text: str = "value") -> DataFrame:
    """Without heartbeats and information events. HTTP and FTP have fields of their own."""
    rows = _objects(raw, text).where(~(F.coalesce(get("$.category") == "heartbeat", F.lit(False)) | F.coalesce(get("$.type") == "info", F.lit(False))))
    http, ftp = get("$.category") == "http", get("$.category") == "ftp"
    command = F.coalesce(get('$["ftp.command"]'), F.lit(""))
    argument = lambda word: F.when(ftp, F.nullif(F.trim(F.regexp_extract(command, f"(?s)^{word} (.*)$", 1)), F.lit("")))
    return _event(
        rows,
        "honeytrap",
        {
            "timestamp": parsed_time(first_of("$.date", "$.timestamp", '$["@timestamp"]', "$.time")),
            "event_type": first_of("$.type", "$.event", "$.category", otherwise=F.lit("unknown")),
            "src_ip": first_of('$["source-ip"]', "$.src_ip", "$.source_ip", "$.src"),
            "src_port": first_number('$["source-port"]', "$.src_port", "$.sport"),
            "dest_ip": first_of('$["destination-ip"]', "$.dst_ip", "$.dest_ip", "$.dst"),
            "dest_port": first_number('$["destination-port"]', "$.dst_port", "$.dport"),
            "protocol": F.when(http, "HTTP").when(ftp, "FTP"),
            "session_id": F.when(http, get('$["http.sessionid"]')).when(ftp, get('$["ftp.sessionid"]')),
            "username": argument("USER"),
            "password": argument("PASS"),
            "request_data": F.when(http, first_of("$.payload", '$["payload-hex"]')).when(ftp, F.nullif(command, F.lit(""))),
            "http_method": F.when(http, get('$["http.method"]')),
            "http_uri": F.when(http, get('$["http.url"]')),
            "http_user_agent": F.when(http, get('$["http.header.user-agent"][0]')),
        },
    )


def normalize_ids(raw: DataFrame, text: str = "value") -> DataFrame:
    """Without statistics. A url is the host and the path, whichever there are."""
    rows = _objects(raw, text).where(~F.coalesce(get("$.event_type") == "stats", F.lit(False)))
    part = lambda *paths: F.coalesce(first_of(*paths), F.lit(""))
    return _event(
        rows,
        "suricata",
        {
            "timestamp": parsed_time(get("$.timestamp")),
            "event_type": first_of("$.event_type", otherwise=F.lit("unknown")),
            "src_ip": get("$.src_ip"),
            "src_port": get("$.src_port").try_cast("int"),
            "dest_ip": get("$.dest_ip"),
            "dest_port": get("$.dest_port").try_cast("int"),
            "protocol": get("$.proto"),
            "session_id": get("$.flow_id"),
            "username": get("$.username"),
            "password": get("$.password"),
            "request_data": first_of("$.payload_printable", "$.payload"),
            "dns_query": get("$.dns.rrname"),
            "http_method": first_of("$.http.method", "$.http.http_method"),
            "http_uri": F.nullif(F.concat(part("$.http.host", "$.http.hostname"), part("$.http.url", "$.http.uri")), F.lit("")),
            "http_user_agent": first_of("$.http.user_agent", "$.http.http_user_agent"),
            "alert_type": get("$.alert.signature"),
            "severity": get("$.alert.severity").try_cast("int"),
        },
    )


#: Sensors by name; more can be added.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"cowrie": normalize_ssh, "honeytrap": normalize_service, "suricata": normalize_ids}


def merged(sources: dict[str, DataFrame]) -> DataFrame:
    """The events of several sensors, by name of the sensor."""
    out = None
    for name, raw in sources.items():
        events = NORMALIZERS[name](raw)
        out = events if out is None else out.unionByName(events)
    return out


def missing_field(events: DataFrame) -> Column:
    """The first required field that is null, or null if none is."""
    return F.coalesce(*(F.when(F.col(c).isNull(), c) for c in REQUIRED))


def valid(events: DataFrame) -> DataFrame:
    return events.where(missing_field(events).isNull())


def quarantined(events: DataFrame) -> DataFrame:
    return events.withColumn("missing_field", missing_field(events)).where("missing_field is not null")


def typed(table: DataFrame) -> DataFrame:
    """A table of text columns with times, numbers and empty texts as the analysis wants them."""
    out = table.withColumn("timestamp", parsed_time(F.col("timestamp").cast("string")))
    out = out.withColumns({c: F.col(c).try_cast("int") for c in ("src_port", "dest_port", "severity") if c in table.columns})
    return out.na.fill("", [c for c, kind in out.dtypes if kind == "string"])
