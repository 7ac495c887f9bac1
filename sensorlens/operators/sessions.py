"""Sessions: runs of events of one key without a long gap, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

GAP_SECONDS = 1800
KEYS = ("src_ip", "dest_ip")
LISTS = {"commands": "request_data", "event_types": "event_type"}
NON_EMPTY_LISTS = {
    "usernames": "username", "passwords": "password", "dest_ports": "dest_port", "protocols": "protocol", "dns_queries": "dns_query", "http_uris": "http_uri",
    "http_user_agents": "http_user_agent", "alert_types": "alert_type",
}


def _micros(a: str, b: str):
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))


def sessionize(events: DataFrame, keys=KEYS, ts: str = "timestamp", order: str = "id", gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """``events`` with ``session`` (keys and number), ``delay``, seconds since the session's event before, cut to milliseconds,
    and ``next_delay``, those to the one after.

    A gap of more than ``gap_seconds`` begins a session. Rows without a time are left out; equal times go by ``order``.
    Windows hold one day of one key; what days hand on to each other, one row for each, goes in a second level, so that a
    busy key is no single task.
    """
    most, given = int(gap_seconds * 1_000_000), events.columns
    day, key, gap_in, gap_out, new, opens, before, after, gap_before, at_key, at_day = own_names(
        given, "day", "key", "gap_in", "gap_out", "new", "opens", "before", "after", "gap_before", "at_key", "at_day"
    )
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    # A struct is never null, so that null keys are a key: windows, days and their join have one partitioning of the events.
    rows = events.where(F.col(ts).isNotNull()).withColumns({day: F.to_date(ts), key: F.struct(*keys)})
    w = W.partitionBy(key, day).orderBy(ts, order)
    marked = rows.withColumns({gap_before: gap(F.lag(ts).over(w), F.col(ts)), after: gap(F.col(ts), F.lead(ts).over(w))})
    marked = marked.withColumn(new, (F.coalesce(gap_before, F.lit(0)) > most).cast("int"))
    days = marked.groupBy(key, day).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.sum(new).alias("inner"))
    by_day = W.partitionBy(key).orderBy(day)
    days = days.withColumns({gap_in: gap(F.lag("last").over(by_day), F.col("first")), gap_out: gap(F.col("last"), F.lead("first").over(by_day))})
    days = days.withColumn(opens, F.coalesce(F.col(gap_in) > most, F.lit(True)).cast("int"))
    earlier = F.coalesce(F.sum(F.col(opens) + F.col("inner")).over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col(key).alias(at_key), F.col(day).alias(at_day), gap_in, gap_out, opens, earlier.alias(before))
    numbered = marked.withColumn(new, F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    full = numbered.join(days.hint("shuffle_hash"), (F.col(key) == F.col(at_key)) & (F.col(day) == F.col(at_day)))
    number = F.col(before) + F.col(opens) + F.col(new)
    name = F.concat_ws("::", *(F.col(k).cast("string") for k in keys), F.concat(F.lit("s"), number.cast("string")))
    delay = lambda c: F.when(c <= most, F.floor(c / 1000) / 1000.0)
    made = {"session": name, "delay": delay(F.coalesce(gap_before, gap_in)), "next_delay": delay(F.coalesce(after, gap_out))}
    return full.select(*(c for c in given if c not in made), *(c.alias(n) for n, c in made.items()))


def own_names(given: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that none of ``given`` has, in any case."""
    taken, out = {c.lower() for c in given}, []
    for name in wanted:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def session_bounds(sessions: DataFrame, keys=KEYS, ts: str = "timestamp") -> DataFrame:
    """``session``, keys, first and last time, number of events and seconds between."""
    first, last = F.min(ts).alias("start_time"), F.max(ts).alias("end_time")
    out = sessions.groupBy("session", *keys).agg(first, last, F.count("*").alias("event_count"))
    return out.withColumn("duration_sec", _micros("start_time", "end_time") / 1_000_000)


def session_mode(sessions: DataFrame, column: str) -> DataFrame:
    """``session`` and its most frequent ``column``; the least one of equals."""
    counts = sessions.where(F.col(column).isNotNull()).groupBy("session", column).agg(F.count("*").alias("n"))
    return counts.groupBy("session").agg(F.min(F.struct(-F.col("n"), F.col(column).alias("value"))).alias("m")).select("session", F.col("m.value").alias(column))


def distinct_in_order(sessions: DataFrame, column: str, name: str, ts: str = "timestamp", order: str = "id", keep_empty: bool = False) -> DataFrame:
    """``session`` and the different values of ``column`` by first occurrence.

    Two levels: values are made distinct by hash aggregation, so that only they, not all events, meet in a list.
    """
    value = F.col(column).cast("string")
    rows = sessions.select("session", F.coalesce(value, F.lit("")).alias("v") if keep_empty else value.alias("v"), ts, order)
    if not keep_empty:
        rows = rows.where("v is not null and v <> ''")
    firsts = rows.groupBy("session", "v").agg(F.min(F.struct(ts, order)).alias("at"))
    return firsts.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))


def delay_statistics(sessions: DataFrame) -> DataFrame:
    """``session`` with mean, deviation (of the population), least and greatest delay, and bursts.

    A burst is a delay under half a second with one over five seconds after it. Sessions of one event have zeros.
    """
    return sessions.groupBy("session").agg(*_delay_figures())


def _delay_figures() -> list:
    burst = (F.col("delay") < 0.5) & (F.col("next_delay") > 5.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.avg("delay")).alias("avg_inter_cmd_delay"), zero(F.stddev_pop("delay")).alias("std_inter_cmd_delay"), zero(F.min("delay")).alias("min_inter_cmd_delay"),
        zero(F.max("delay")).alias("max_inter_cmd_delay"), F.count_if(burst).alias("burst_count"),
    ]


def build_sessions(events: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """One row for each gap session: bounds, source, ordered distinct lists and delays, all in one pass over marked events.

    Each event stands once for its session's numbers beside its values for the lists, so that what is grouped by session and
    value has the numbers in a group of its own.
    """
    bounds = [*(F.first(k).alias(k) for k in KEYS), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("event_count")]
    bounds.append(F.count_if(F.lower("event_type").rlike("login|auth|connect")).alias("login_event_count"))
    whole = session_lists(sessionize(events, gap_seconds=gap_seconds), [*bounds, *_delay_figures()])  # a session has one of each key
    return whole.withColumn("duration_sec", _micros("start_time", "end_time") / 1_000_000)


def sensor_sessions(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """The same by the sensors' own session ids, all or one; delays are those between first uses of commands."""
    rows = events.where("session_id <> ''" if session_id is None else F.col("session_id") == session_id).where("timestamp is not null")
    rows = rows.withColumn("session", F.col("session_id"))
    at = F.struct("timestamp", "id")
    firsts = rows.where("request_data <> ''").groupBy("session", "request_data").agg(F.min(at).alias("at")).select("session", "at.timestamp", "at.id")
    before = F.lag("timestamp").over(W.partitionBy("session").orderBy("timestamp", "id"))
    timed = firsts.withColumn("delay", F.floor(F.timestamp_diff("MICROSECOND", before, F.col("timestamp")) / 1000) / 1000.0)
    timed = timed.withColumn("next_delay", F.lead("delay").over(W.partitionBy("session").orderBy("timestamp", "id")))
    ends = rows.groupBy("session").agg(F.min_by("src_ip", at).alias("src_ip"), F.min_by("dest_ip", at).alias("dest_ip"))
    numbers = session_bounds(rows, ()).join(ends, "session").join(delay_statistics(timed), "session", "left")
    return numbers.na.fill(0).join(session_lists(rows), "session")


def session_lists(marked: DataFrame, numbers: list | None = None) -> DataFrame:
    """``session``, its most frequent source and its ordered distinct lists; with ``numbers``, aggregates of its events, beside them."""
    given = {name: column for name, column in {**LISTS, **NON_EMPTY_LISTS, "_source": "log_source"}.items() if column in marked.columns}
    empty = lambda name, column: F.coalesce(F.col(column).cast("string"), F.lit("")) if name in LISTS else F.col(column).cast("string")
    values = [F.struct(F.lit(name).alias("name"), empty(name, column).alias("v")) for name, column in given.items()]
    kept = ["timestamp", "id"]
    if numbers:
        values.append(F.struct(F.lit("").alias("name"), F.lit("").alias("v")))
        kept += [*(k for k in (*KEYS, "event_type") if k in marked.columns), "delay", "next_delay"]
    rows = marked.select("session", *kept, F.explode(F.array(*values)).alias("p")).select("session", *kept, "p.*")
    rows = rows.where(F.col("name").isin(*LISTS, "") | (F.col("v") != ""))
    if numbers:  # only the group of numbers has any
        rows = rows.withColumns({c: F.when(F.col("name") == "", F.col(c)) for c in ("delay", "next_delay")})
    firsts = rows.groupBy("session", "name", "v").agg(F.min(F.struct("timestamp", "id")).alias("at"), F.count("*").alias("n"), *(numbers or []))
    own = [c for c in firsts.columns if c not in ("session", "name", "v", "at", "n")]
    found = [F.max(F.when(F.col("name") == "", F.struct(*own))).alias("_numbers")] if own else []
    gathered = firsts.groupBy("session").agg(F.collect_list(F.when(F.col("name") != "", F.struct("name", "at", "v", "n"))).alias("_all"), *found)
    of = lambda name: F.filter("_all", lambda x: x["name"] == name)
    ordered = lambda name: F.transform(F.array_sort(F.transform(of(name), lambda x: F.struct(x["at"], x["v"].alias("v")))), lambda x: x["v"])
    source = F.coalesce(F.array_min(F.transform(of("_source"), lambda x: F.struct(-x["n"], x["v"].alias("v"))))["v"], F.lit(""))
    lists = [source.alias("log_source"), *(ordered(name).alias(name) for name in given if name != "_source")]
    return gathered.select("session", *(F.col(f"_numbers.{c}").alias(c) for c in own), *lists)
