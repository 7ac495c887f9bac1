"""Answers for operators of sensors: totals, top lists, profiles, drill-downs. All take a table of normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import net, text as T

MOST_SESSIONS, MOST_LOGS, MOST_LATEST = 200, 500, 1000
#: Columns of the answers to questions for events and for one session.
LOG_COLUMNS = ["id", "timestamp", "log_source", "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "protocol", "session_id", "username", "request_data"]
TIMELINE_COLUMNS = [*LOG_COLUMNS, "password", "dns_query", "http_method", "http_uri", "alert_type", "severity"]


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` greatest by ``by``; equals in the order of ``ties``."""
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("cnt"))


def health(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("row_count")).withColumn("present", F.col("row_count") > 0)


def top_sources(events: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
    return top(counts(events.where(net.is_public(F.col("src_ip"), strict)), "src_ip"), "cnt", k, "src_ip")


def top_event_types(events: DataFrame, k: int = 12) -> DataFrame:
    return top(counts(events, "event_type"), "cnt", k, "event_type")


def sessions_per_source(events: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return events.where("session_id <> ''").groupBy("log_source").agg(distinct("session_id").alias("sessions"))


def daily_histogram(events: DataFrame, days: int = 40) -> DataFrame:
    """Events of each of the last ``days`` days before the latest one, both included."""
    last = events.agg(F.to_date(F.max("timestamp")).alias("last"))
    day = events.select(F.to_date("timestamp").alias("day"))
    return day.join(F.broadcast(last), F.col("day") >= F.date_sub("last", days)).groupBy("day").agg(F.count("*").alias("cnt"))  # one row


def profiles(events: DataFrame, k: int = 10) -> DataFrame:
    """The busiest public addresses with sessions, commands, logins and times."""
    hits = lambda part: F.count_if(T.contains(F.col("event_type"), part))
    grouped = events.where(net.is_public(F.col("src_ip"))).groupBy("src_ip").agg(
        F.count("*").alias("total_events"), F.countDistinct("session_id").alias("sessions"), hits("command").alias("commands"), hits("login_success").alias("successful_logins"),
        hits("login_failed").alias("failed_logins"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return top(grouped, "total_events", k, "src_ip")


def _like(text: str) -> Column:
    return F.lower(F.col(text))


def session_list(events: DataFrame, limit: int = 50, search: str | None = None) -> DataFrame:
    """Sessions by events. ``search``: part of a session id or address, in any case, taken literally."""
    rows = events.where("session_id <> ''")
    if search:
        rows = rows.where(_like("session_id").contains(search.lower()) | _like("src_ip").contains(search.lower()))
    grouped = rows.groupBy("session_id").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("event_count"), F.countDistinct("event_type").alias("event_types"),
        F.concat_ws(",", F.array_sort(F.collect_set("log_source"))).alias("sources"), F.max("src_ip").alias("src_ip"), F.max("username").alias("username"),
    )
    return top(grouped, "event_count", min(limit, MOST_SESSIONS), "session_id")


def latest(events: DataFrame, limit: int = 100, log_source: str | None = None, event_type: str | None = None, by: str = "id") -> DataFrame:
    for column, wanted in (("log_source", log_source), ("event_type", event_type)):
        if wanted:
            events = events.where(F.col(column) == wanted)
    return events.orderBy(F.col(by).desc()).limit(min(limit, MOST_LOGS))


def latest_in_time(events: DataFrame, limit: int = MOST_LATEST) -> DataFrame:
    """The latest events by time; of equal times those of the greatest id."""
    return events.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(min(limit, MOST_LATEST))


def answer(events: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the events, those that they have."""
    return events.select(*(c for c in columns if c in events.columns))


def session_types(events: DataFrame) -> DataFrame:
    """Events of each type inside each session."""
    return events.where("session_id <> ''").groupBy("session_id", "event_type").agg(F.count("*").alias("cnt"))


def session_ids(events: DataFrame) -> DataFrame:
    return events.where("session_id is not null").select("session_id").distinct()


def session_answer(events: DataFrame, session_id: str) -> dict[str, DataFrame]:
    """All that a page on one session shows: its summary, timeline, credentials and commands."""
    rows = events.where(F.col("session_id") == session_id)
    commands_ = rows.where("request_data <> ''").groupBy("request_data").agg(F.min(F.struct("timestamp", "id")).alias("at"), F.count("*").alias("cnt"))
    return {
        "summary": session_summary(rows),
        "timeline": answer(timeline(rows, session_id), TIMELINE_COLUMNS),
        "credentials": credentials(rows).orderBy("username", "password").limit(50),
        "commands": commands_.orderBy("at").limit(100).select("request_data", F.col("at.timestamp").alias("first_seen"), "cnt"),
    }


def places(geo: DataFrame, search: str | None = None, order: str = "query") -> DataFrame:
    """Records of places, those whose address holds ``search`` in any case; null addresses hold nothing."""
    return geo if not search else geo.where(T.contains(F.col(order), search))


def session_summary(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """One row for each session, or for the one asked for."""
    rows = events if session_id is None else events.where(F.col("session_id") == session_id)
    some = lambda c: F.countDistinct(F.when(F.col(c) != "", F.col(c)))
    hits = lambda part: F.count_if(T.contains(F.col("event_type"), part))
    return rows.groupBy("session_id").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("total_events"), F.countDistinct("event_type").alias("event_types"),
        some("username").alias("usernames"), some("password").alias("passwords"), some("request_data").alias("requests"), some("http_uri").alias("uris"), F.countDistinct("dest_port").alias("ports"),
        hits("login_failed").alias("failed_logins"), hits("login_success").alias("successful_logins"), hits("command").alias("commands"), hits("download").alias("downloads"), hits("alert").alias("alerts"),
        F.max("src_ip").alias("src_ip"),
    )


def timeline(events: DataFrame, session_id: str, limit: int = 500) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("timestamp", "id").limit(limit)


def credentials(events: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = events if session_id is None else events.where(F.col("session_id") == session_id)
    return rows.where("username <> '' or password <> ''").select("username", "password").distinct()


def first_seen(events: DataFrame) -> DataFrame:
    """Each command with its first time and the event type it had then."""
    return events.where("request_data <> ''").groupBy("request_data").agg(F.min("timestamp").alias("first_seen"), F.min_by("event_type", F.struct("timestamp", "id")).alias("event_type"))


def ports(events: DataFrame, k: int = 20) -> DataFrame:
    kinds = F.concat_ws(",", F.array_sort(F.collect_set("event_type")))
    grouped = events.where("dest_port <> 0").groupBy("dest_port").agg(F.count("*").alias("cnt"), kinds.alias("event_types"))
    named = grouped.withColumns({"service": F.coalesce(net.port_name(F.col("dest_port")), F.lit("")), "sensitive": F.col("dest_port").isin(net.SENSITIVE_PORTS)})
    return top(named, "cnt", k, "dest_port")


def commands(events: DataFrame, k: int = 12, shorter_than: int = 80) -> DataFrame:
    rows = events.where(T.contains(F.col("event_type"), "command") & (F.col("request_data") != "") & (F.length("request_data") < shorter_than))
    return top(counts(rows, "request_data"), "cnt", k, "request_data")


def command_totals(events: DataFrame) -> DataFrame:
    rows = events.where(T.contains(F.col("event_type"), "command") & (F.col("request_data") != ""))
    return rows.agg(F.count("*").alias("total"), F.countDistinct("request_data").alias("different"))


def shares(counted: DataFrame, key: str) -> DataFrame:
    """``key, cnt`` with rank, share of all and ratio to the greatest. For short lists, such as a top k."""
    w = W.partitionBy()
    return counted.select(
        key, "cnt", F.row_number().over(W.orderBy(F.col("cnt").desc(), key)).alias("rank"), (F.col("cnt") / F.sum("cnt").over(w)).alias("share"),
        (F.col("cnt") / F.max("cnt").over(w)).alias("of_max"),
    )


def countries(geo: DataFrame, k: int = 50, order: str = "query") -> DataFrame:
    """Sums by country with place and organisation of the first record; a missing count is 1."""
    n = F.coalesce(F.nullif("count", F.lit(0)), F.lit(1))
    grouped = geo.groupBy(F.coalesce(F.nullif("country", F.lit("")), F.lit("Unknown")).alias("country")).agg(
        F.sum(n).alias("cnt"), F.min_by("lat", order).alias("lat"), F.min_by("lon", order).alias("lon"), F.min_by("org", order).alias("org"),
    )
    return top(grouped, "cnt", k, "country")


def infrastructure(geo: DataFrame) -> DataFrame:
    n = F.coalesce(F.nullif("count", F.lit(0)), F.lit(1))
    return geo.groupBy(net.organisation_class(F.col("org")).alias("asn_type")).agg(F.sum(n).alias("cnt"))
