"""Queries over the driver's tables, one for each operator or group of operators, with the SQL that gives the same rows.

Times are returned as text, and doubles rounded to six places, so that engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import net, text as T
from ..operators import corpus, evaluation, features, labels, metrics, mlprep, normalize, sessions, soc
from .driver_log import LOG_SQL, WIDE_SQL, event_log, wide_log
from .intelligence_sql import intelligence_sql
from .stated import LEAKS

GAP = 7200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, log: bool = True):
    """Registers a function under its name, with ``sql`` over the tables, and over ``log`` where that is said."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (LOG_SQL if log else "") + sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


def _r(c, name: str, places: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, places) + F.lit(0.0)).alias(name)


# --- sessions

#: Sessions in SQL: gap runs by address, with the delay in whole milliseconds.
SESSION_SQL = f""", gaps AS (SELECT *, lag(timestamp) OVER k AS before FROM log WINDOW k AS (PARTITION BY src_ip, dest_ip ORDER BY timestamp, id)),
marked AS (SELECT *, CASE WHEN before IS NULL OR epoch_us(timestamp) - epoch_us(before) > {GAP * 1_000_000}::BIGINT THEN 1 ELSE 0 END AS fresh FROM gaps),
s AS (SELECT *, src_ip || '::' || dest_ip || '::s' || (sum(fresh) OVER (PARTITION BY src_ip, dest_ip ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING))::BIGINT::VARCHAR AS session,
  CASE WHEN fresh = 0 THEN floor((epoch_us(timestamp) - epoch_us(before)) / 1000) / 1000.0 END AS delay FROM marked)
"""
#: The one before with delay statistics and rate by session.
STATS_SQL = SESSION_SQL + """, n AS (SELECT *, lead(delay) OVER (PARTITION BY session ORDER BY timestamp, id) AS next FROM s),
d AS (SELECT session, coalesce(avg(delay), 0) AS avg_delay, coalesce(stddev_pop(delay), 0) AS std_delay, coalesce(min(delay), 0) AS min_delay, coalesce(max(delay), 0) AS max_delay,
  count(*) FILTER (WHERE delay < 0.5 AND next > 5.0) AS bursts, count(*) AS events, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0 AS duration FROM n GROUP BY session),
r AS (SELECT *, CASE WHEN duration > 0 THEN events / (duration / 60) ELSE events::DOUBLE END AS per_minute, CASE WHEN avg_delay > 0 THEN std_delay / avg_delay ELSE 0.0 END AS variance FROM d)
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(event_log(spark, sf_dir), gap_seconds=GAP)


@query(SESSION_SQL + "SELECT id, session, round(delay, 6) AS delay FROM s")
def sessionize_gap(spark, sf_dir):
    return _sessions(spark, sf_dir).select("id", "session", _r("delay", "delay"))


@query(SESSION_SQL + "SELECT session, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS end_time, count(*) AS event_count, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0, 6) AS duration_sec FROM s GROUP BY session")
def session_summary(spark, sf_dir):
    return sessions.session_bounds(_sessions(spark, sf_dir)).select("session", _time("start_time"), _time("end_time"), "event_count", _r("duration_sec", "duration_sec"))


@query(SESSION_SQL + "SELECT session, event_type FROM (SELECT session, event_type, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, event_type) AS k FROM s GROUP BY session, event_type) WHERE k = 1")
def session_mode(spark, sf_dir):
    return sessions.session_mode(_sessions(spark, sf_dir), "event_type")


@query(SESSION_SQL + ", f AS (SELECT session, event_type AS v, min(timestamp) AS t, arg_min(id, (timestamp, id)) AS i FROM s GROUP BY session, event_type) SELECT session, string_agg(v, '|' ORDER BY t, i) AS event_types FROM f GROUP BY session")
def session_distinct_lists(spark, sf_dir):
    return sessions.distinct_in_order(_sessions(spark, sf_dir), "event_type", "x", keep_empty=True).select("session", F.array_join("x", "|").alias("event_types"))


@query(STATS_SQL + "SELECT session, round(avg_delay, 6) AS avg_delay, round(std_delay, 6) AS std_delay, round(min_delay, 6) AS min_delay, round(max_delay, 6) AS max_delay, bursts FROM r")
def delay_statistics(spark, sf_dir):
    d = sessions.delay_statistics(_sessions(spark, sf_dir))
    return d.select("session", *(_r(f"{a}_inter_cmd_delay", f"{a}_delay") for a in ("avg", "std", "min", "max")), F.col("burst_count").alias("bursts"))


def _timing(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    return features.timing_features(sessions.session_bounds(s).join(sessions.delay_statistics(s), "session"))


@query(STATS_SQL + "SELECT session, round(per_minute, 6) AS per_minute, round(variance, 6) AS variance FROM r")
def timing_ratios(spark, sf_dir):
    return _timing(spark, sf_dir).select("session", _r("events_per_minute", "per_minute"), _r("timing_variance_ratio", "variance"))


AUTOMATION_SQL = STATS_SQL + """, u AS (SELECT session, count(DISTINCT request_data) FILTER (WHERE request_data <> '')::DOUBLE / greatest(1, count(request_data) FILTER (WHERE request_data <> '')) AS uniq FROM s GROUP BY session),
a AS (SELECT r.session, events, least(greatest(0.5::DOUBLE - least(greatest(variance * 0.2::DOUBLE, 0), 0.2::DOUBLE) + CASE WHEN per_minute > 20 THEN 0.2::DOUBLE WHEN per_minute > 5 THEN 0.1::DOUBLE ELSE 0 END
  - least(greatest(uniq * 0.2::DOUBLE, 0), 0.2::DOUBLE) + CASE WHEN bursts > 3 THEN 0.1::DOUBLE ELSE 0 END, 0), 1) AS raw FROM r JOIN u USING (session))
"""


def _automation(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    some = F.when(F.col("request_data") != "", F.col("request_data"))
    unique = s.groupBy("session").agg((F.countDistinct(some) / F.greatest(F.lit(1), F.count(some))).alias("cmd_unique_ratio"))
    timing = features.timing_features(sessions.session_bounds(s).join(sessions.delay_statistics(s), "session"))
    return labels.automation_profile(timing.join(unique, "session"))


@query(AUTOMATION_SQL + ", b AS (SELECT *, round_even(raw, 2)::DOUBLE AS score FROM a) SELECT session, events AS event_count, round(score, 6) AS automation_score, CASE WHEN score >= 0.7 THEN 'scripted' WHEN score <= 0.3 THEN 'manual' ELSE 'mixed' END AS automation_likelihood FROM b")
def automation_profile(spark, sf_dir):
    return _automation(spark, sf_dir).select("session", "event_count", _r("automation_score", "automation_score"), "automation_likelihood")


@query(SESSION_SQL + """, c AS (SELECT session, min(timestamp) AS t, arg_min(id, (timestamp, id)) AS i, request_data AS v FROM s WHERE request_data IS NOT NULL GROUP BY session, request_data),
j AS (SELECT session, string_agg(v, '|' ORDER BY t, i) AS cmds, count(*) AS n FROM c GROUP BY session)
SELECT session, n AS commands, regexp_matches(cmds, '(?is)(wget|curl|tftp)\\b.*(chmod|sh\\s|bash\\s|python)')::INT AS chain, regexp_matches(cmds, '(?i)\\b(uname|whoami|id|ifconfig|ip\\s+a|cat\\s+/etc/passwd|hostname|netstat)\\b')::INT AS recon,
 regexp_matches(cmds, '(?i)\\b(wget|curl|tftp|ftp|scp)\\b')::INT AS downloader, regexp_matches(cmds, '(?i)(crontab|\\.bashrc|systemctl\\s+enable|rc\\.local)')::INT AS persistence,
 regexp_matches(cmds, '(?i)\\b(rm\\s+-rf|mkfs|dd\\s+if=|killall)\\b')::INT AS destructive, regexp_matches(cmds, '(?i)ssh\\s+.*-[LRD]\\s|socat\\b|proxychains\\b')::INT AS forwarding FROM j""")
def command_flags(spark, sf_dir):
    s = sessions.distinct_in_order(_sessions(spark, sf_dir), "request_data", "commands")
    f = features.command_features(s, split_pipes=False)
    return f.select("session", F.size("commands").cast("long").alias("commands"), F.col("has_download_execute_chain").alias("chain"), F.col("has_recon_commands").alias("recon"), F.col("has_downloader").alias("downloader"), F.col("has_persistence").alias("persistence"), F.col("has_destructive").alias("destructive"), F.col("has_port_forwarding").alias("forwarding"))


@query(SESSION_SQL + """, g AS (SELECT session, count(DISTINCT event_type) FILTER (WHERE event_type LIKE '%login%') AS cred, count(DISTINCT password) FILTER (WHERE password <> '') AS pwd, count(DISTINCT dest_port) AS ports, count(DISTINCT username) FILTER (WHERE username <> '') AS users,
  bool_or(request_data = 'uname -a' OR request_data = 'cat /etc/passwd') AS recon, bool_or(request_data LIKE 'rm -rf%') AS destr, bool_or(request_data LIKE '%-L 80:%') AS fwd, bool_or(request_data LIKE '%10.0.0.5%') AS scan FROM s GROUP BY session)
SELECT session, cred AS credential_attempts, users AS unique_usernames, pwd AS unique_passwords, ports AS unique_dest_ports, (cred >= 3 AND pwd >= 2)::INT AS brute_force, coalesce(fwd, false)::INT AS tunneling, (coalesce(scan, false) OR (coalesce(fwd, false) AND coalesce(recon, false)))::INT AS lateral_movement,
 coalesce(recon, false)::INT AS reconnaissance, coalesce(destr, false)::INT AS destructive, (ports >= 3)::INT AS port_scan, (cred >= 1 AND NOT (cred >= 3 AND pwd >= 2))::INT AS credential_spray FROM g""")
def rule_labels(spark, sf_dir):
    f = labels.attack_labels(features.session_features(sessions.build_sessions(event_log(spark, sf_dir), GAP)))
    wide = ["credential_attempts", "unique_usernames", "unique_passwords", "unique_dest_ports"]
    return f.select("session", *(F.col(c).cast("long").alias(c) for c in wide), *(F.col(f"label_{n}").alias(n) for n in ("brute_force", "tunneling", "lateral_movement", "reconnaissance", "destructive", "port_scan", "credential_spray")))


@query(intelligence_sql(WIDE_SQL + STATS_SQL.replace("FROM log WINDOW", "FROM wide WINDOW")))
def session_intelligence(spark, sf_dir):
    from .behaviour import session_intelligence as plan

    full = plan(wide_log(spark, sf_dir), GAP)
    numbers = {c: _r(c, c) if kind == "double" else F.col(c).cast("long").alias(c) for c, kind in full.dtypes if kind in ("double", "int", "bigint")}
    texts = ["session", "log_source", "attack_labels", "automation_likelihood"]
    left_out = {"src_ip", "dest_ip", "event_count", "duration_sec", "burst_count", *(f"{a}_inter_cmd_delay" for a in ("avg", "std", "min", "max"))}
    return full.select(*texts, *(v for c, v in numbers.items() if c not in left_out))


# --- answers


@query("SELECT event_type, count(*) AS cnt FROM log GROUP BY 1 ORDER BY cnt DESC, event_type LIMIT 12")
def top_event_types(spark, sf_dir):
    return soc.top_event_types(event_log(spark, sf_dir))


PUBLIC = "src_ip <> '' AND src_ip <> '0.0.0.0' AND src_ip NOT LIKE '192.168.%' AND src_ip NOT LIKE '10.%' AND src_ip NOT LIKE '172.1_.%' AND src_ip NOT LIKE '172.2_.%' AND src_ip NOT LIKE '172.3_.%'"


@query(f"SELECT src_ip, count(*) AS cnt FROM log WHERE {PUBLIC} GROUP BY 1 ORDER BY cnt DESC, src_ip LIMIT 10")
def top_sources(spark, sf_dir):
    return soc.top_sources(event_log(spark, sf_dir))


@query("SELECT log_source, count(DISTINCT session_id) AS sessions FROM log WHERE session_id <> '' GROUP BY 1")
def sessions_per_source(spark, sf_dir):
    return soc.sessions_per_source(event_log(spark, sf_dir))


@query("SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS cnt FROM log WHERE timestamp::DATE >= (SELECT max(timestamp)::DATE - 40 FROM log) GROUP BY 1")
def daily_histogram(spark, sf_dir):
    return soc.daily_histogram(event_log(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "cnt")


@query(f"""SELECT src_ip, count(*) AS total_events, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE event_type ILIKE '%command%') AS commands, count(*) FILTER (WHERE event_type ILIKE '%login_success%') AS successful_logins,
 count(*) FILTER (WHERE event_type ILIKE '%login_failed%') AS failed_logins, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM log WHERE {PUBLIC} GROUP BY 1 ORDER BY total_events DESC, src_ip LIMIT 10""")
def source_profiles(spark, sf_dir):
    p = soc.profiles(event_log(spark, sf_dir))
    return p.withColumns({c: _time(c) for c in ("first_seen", "last_seen")})


@query("""SELECT session_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, count(*) AS event_count, count(DISTINCT event_type) AS event_types, string_agg(DISTINCT log_source, ',' ORDER BY log_source) AS sources, max(src_ip) AS src_ip, max(username) AS username
 FROM log WHERE session_id <> '' GROUP BY 1 ORDER BY event_count DESC, session_id LIMIT 50""")
def session_list(spark, sf_dir):
    return soc.session_list(event_log(spark, sf_dir)).withColumn("start_time", _time("start_time")).drop("end_time")


@query("SELECT session_id, count(*) AS event_count FROM log WHERE session_id ILIKE '%U1%' OR src_ip ILIKE '%U1%' GROUP BY 1 ORDER BY event_count DESC, session_id LIMIT 200")
def session_search(spark, sf_dir):
    return soc.session_list(event_log(spark, sf_dir), 500, "U1").select("session_id", "event_count")


@query("""SELECT session_id, count(*) AS total_events, count(DISTINCT username) FILTER (WHERE username <> '') AS usernames, count(DISTINCT password) FILTER (WHERE password <> '') AS passwords, count(DISTINCT request_data) FILTER (WHERE request_data <> '') AS requests,
 count(DISTINCT http_uri) FILTER (WHERE http_uri <> '') AS uris, count(DISTINCT dest_port) AS ports, count(*) FILTER (WHERE event_type ILIKE '%login_failed%') AS failed_logins, count(*) FILTER (WHERE event_type ILIKE '%login_success%') AS successful_logins, count(*) FILTER (WHERE event_type ILIKE '%command%') AS commands, count(*) FILTER (WHERE event_type ILIKE '%alert%') AS alerts, count(DISTINCT event_type) AS event_types,
 count(*) FILTER (WHERE event_type ILIKE '%download%') AS downloads, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS end_time, max(src_ip) AS src_ip FROM log GROUP BY 1""")
def session_drilldown(spark, sf_dir):
    return soc.session_summary(event_log(spark, sf_dir)).withColumns({c: _time(c) for c in ("start_time", "end_time")})


@query("SELECT DISTINCT username, password FROM log WHERE username <> '' OR password <> ''")
def credential_pairs(spark, sf_dir):
    return soc.credentials(event_log(spark, sf_dir))


@query("SELECT request_data, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, arg_min(event_type, (timestamp, id)) AS event_type FROM log WHERE request_data <> '' GROUP BY 1")
def first_seen_commands(spark, sf_dir):
    return soc.first_seen(event_log(spark, sf_dir)).withColumn("first_seen", _time("first_seen"))


@query("SELECT dest_port, count(*) AS cnt, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, CASE dest_port WHEN 22 THEN 'SSH' WHEN 23 THEN 'Telnet' WHEN 21 THEN 'FTP' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 3389 THEN 'RDP' WHEN 3306 THEN 'MySQL' WHEN 5432 THEN 'Postgres' ELSE '' END AS service, dest_port IN (21, 22, 23, 80, 443, 3389) AS sensitive FROM log WHERE dest_port <> 0 GROUP BY 1 ORDER BY cnt DESC, dest_port LIMIT 20")
def port_profile(spark, sf_dir):
    return soc.ports(event_log(spark, sf_dir))


@query("SELECT request_data, count(*) AS cnt FROM log WHERE event_type ILIKE '%command%' AND request_data <> '' AND length(request_data) < 80 GROUP BY 1 ORDER BY cnt DESC, request_data LIMIT 12")
def command_frequency(spark, sf_dir):
    return soc.commands(event_log(spark, sf_dir))


@query("SELECT count(*) AS total, count(DISTINCT request_data) AS different FROM log WHERE event_type ILIKE '%command%' AND request_data <> ''")
def command_totals(spark, sf_dir):
    return soc.command_totals(event_log(spark, sf_dir))


@query("SELECT id, log_source, event_type, src_ip FROM log WHERE log_source = 'cowrie' ORDER BY id DESC LIMIT 100")
def latest_events(spark, sf_dir):
    return soc.latest(event_log(spark, sf_dir), 100, "cowrie").select("id", "log_source", "event_type", "src_ip")


@query("SELECT event_type, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS rank, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / max(count(*)) OVER (), 6) AS of_max FROM log GROUP BY 1")
def share_of_total(spark, sf_dir):
    return soc.shares(soc.counts(event_log(spark, sf_dir), "event_type"), "event_type").select("event_type", "cnt", "rank", _r("share", "share"), _r("of_max", "of_max"))


@query("SELECT CASE WHEN event_type LIKE '%login_success%' THEN 'login_success' WHEN event_type LIKE '%login_failed%' THEN 'login_failed' WHEN event_type LIKE '%command%' THEN 'command' WHEN event_type LIKE '%download%' THEN 'download' WHEN event_type LIKE '%alert%' THEN 'alert' WHEN event_type LIKE '%request%' THEN 'request' ELSE 'other' END AS event_class, count(*) AS cnt FROM log GROUP BY 1")
def event_classes(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy(net.event_class(F.col("event_type")).alias("event_class")).agg(F.count("*").alias("cnt"))


GEO_SQL = ", geo AS (SELECT c_custkey AS query, n_name AS country, c_acctbal AS lat, c_acctbal / 2 AS lon, ['Big Cloud', 'City Telecom', 'Mill', 'Fast Network', 'VPS Ltd'][(c_custkey % 5 + 1)::INT] AS org, (c_custkey % 4)::BIGINT AS count FROM customer JOIN nation ON c_nationkey = n_nationkey)\n"


def _geo(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    org = F.element_at(F.array(*map(F.lit, ["Big Cloud", "City Telecom", "Mill", "Fast Network", "VPS Ltd"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("query"), F.col("n_name").alias("country"), F.col("c_acctbal").alias("lat"), (F.col("c_acctbal") / 2).alias("lon"), org.alias("org"), (F.col("c_custkey") % 4).alias("count"))


@query(GEO_SQL + "SELECT country, sum(CASE WHEN count = 0 THEN 1 ELSE count END)::BIGINT AS cnt, arg_min(lat, query) AS lat, arg_min(lon, query) AS lon, arg_min(org, query) AS org FROM geo GROUP BY 1 ORDER BY cnt DESC, country LIMIT 50")
def country_rollup(spark, sf_dir):
    return soc.countries(_geo(spark, sf_dir))


@query(GEO_SQL + "SELECT CASE WHEN lower(org) SIMILAR TO '.*(cloud|hosting|vps).*' THEN 'Hosting/Cloud' WHEN lower(org) SIMILAR TO '.*(telecom|isp|mobile|communications|broadband|network).*' THEN 'Residential/ISP' ELSE 'Unknown/Other' END AS asn_type, sum(CASE WHEN count = 0 THEN 1 ELSE count END)::BIGINT AS cnt FROM geo GROUP BY 1")
def infrastructure_classes(spark, sf_dir):
    return soc.infrastructure(_geo(spark, sf_dir))


# --- text


@query("SELECT doc_id, length(t) AS n, round(CASE WHEN length(t) = 0 THEN 0 ELSE (SELECT -sum(c / length(t)::DOUBLE * log2(c / length(t)::DOUBLE)) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(t, '')) AS ch) GROUP BY ch)) END, 6) + 0.0 AS entropy FROM (SELECT doc_id, text AS t FROM documents)", log=False)
def char_entropy(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), _r(T.char_entropy(F.col("t")), "entropy"))


@query("SELECT doc_id, regexp_matches(text, '(?i)all rights reserved|licensed under')::INT AS licence, (text ILIKE '%token%')::INT AS token, regexp_matches(text, '([0-9a-fA-F]{2}){10,}')::INT AS encoded FROM documents", log=False)
def text_flags(spark, sf_dir):
    d, t = _t(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.flag(t, "all rights reserved|licensed under").alias("licence"), T.contains(t, "token").cast("int").alias("token"), T.flag(t, T.HEX_RUN, True).alias("encoded"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN url LIKE '%m.%' THEN 1 ELSE 0 END AS mobile FROM pages", log=False)
def url_hosts(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), T.contains(F.col("url"), "m.").cast("int").alias("mobile"))


# --- corpus

PAIRS_SQL = """WITH m AS (SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER w <> 'user', true) THEN 1 ELSE 0 END AS opens FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS pair FROM m),
q AS (SELECT conv_id, pair, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS instruction, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS output FROM p WHERE pair > 0 GROUP BY conv_id, pair),
pairs AS (SELECT * FROM q WHERE instruction <> '' AND output <> '')
"""


def _pairs(spark, sf_dir):
    return corpus.turn_pairs(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant")


@query(PAIRS_SQL + "SELECT * FROM pairs", log=False)
def turn_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(PAIRS_SQL + """, u AS (SELECT instruction, output, conv_id * 1000 + pair AS ord, 0 AS source_rank FROM pairs UNION ALL SELECT text, text, item_id, 1 FROM benchmark UNION ALL SELECT instruction, 'again', conv_id * 1000 + pair, 2 FROM pairs)
SELECT instruction, output, source_rank::INT AS source_rank FROM u QUALIFY row_number() OVER (PARTITION BY trim(instruction) ORDER BY source_rank, ord) = 1""", log=False)
def corpus_union(spark, sf_dir):
    first = _pairs(spark, sf_dir).select("instruction", "output", (F.col("conv_id") * 1000 + F.col("pair")).alias("ord"))
    second = _t(spark, sf_dir, "benchmark").select(F.col("text").alias("instruction"), F.col("text").alias("output"), F.col("item_id").alias("ord"))
    return corpus.without_repeats([first, second, first.withColumn("output", F.lit("again"))])


@query("""SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT - 1 AS part, c AS sub_command, regexp_extract(regexp_extract(c, '^\\S+'), '[^/]*$') AS base_cmd
 FROM (SELECT id, unnest(string_split_regex(request_data, '\\s*(?:&&|;)\\s*')) AS c, generate_subscripts(string_split_regex(request_data, '\\s*(?:&&|;)\\s*'), 1) AS k FROM log WHERE event_type = 'ssh_command')""")
def chained_commands(spark, sf_dir):
    rows = event_log(spark, sf_dir).where("event_type = 'ssh_command'").select("id", F.col("request_data").alias("command"))
    return corpus.chained(rows).drop("command")


@query("""SELECT id, base_cmd, CASE base_cmd WHEN 'uname' THEN 'Linux' WHEN 'ls' THEN 'bin etc' ELSE '-bash: ' || base_cmd || ': command not found' END AS response FROM (SELECT id, regexp_extract(regexp_extract(request_data, '^\\S+'), '[^/]*$') AS base_cmd FROM log WHERE event_type = 'ssh_command')""")
def lookup_response(spark, sf_dir):
    known = spark.createDataFrame([("uname", "Linux"), ("ls", "bin etc")], "base_cmd string, response string")
    rows = event_log(spark, sf_dir).where("event_type = 'ssh_command'").select("id", corpus.base_command(F.col("request_data")).alias("base_cmd"))
    return corpus.with_response(rows, known).select("id", "base_cmd", "response")


@query("SELECT DISTINCT username, password FROM log WHERE event_type = 'ssh_login_failed'")
def login_messages(spark, sf_dir):
    raw = event_log(spark, sf_dir).where("event_type = 'ssh_login_failed'").select(F.format_string("login attempt [%s/%s] failed", "username", "password").alias("raw"))
    return corpus.login_pairs(raw)


@query("""SELECT ord, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '[^/]*$') AS file_name, CASE WHEN row_number() OVER (ORDER BY ord) % 2 = 1 THEN 'wget' ELSE 'curl' END AS form FROM (SELECT min(id) AS ord, request_data AS url FROM log WHERE event_type = 'ssh_file_downloaded' GROUP BY request_data)""")
def download_pairs(spark, sf_dir):
    rows = event_log(spark, sf_dir).where("event_type = 'ssh_file_downloaded'").select(F.col("id").alias("ord"), F.to_json(F.struct(F.col("request_data").alias("url"))).alias("raw"))
    return corpus.download_pairs(rows).drop("shasum")


# --- training data

LABELLED_SQL = "WITH d AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, (n_chars % 97)::DOUBLE AS odd, quality, toxic FROM documents JOIN labels USING (doc_id))\n"


def _labelled(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("n_chars") % 97).cast("double").alias("odd"), "quality", "toxic")


@query(LABELLED_SQL + ", l AS (UNPIVOT (SELECT quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM d) ON quality, toxic INTO NAME label VALUE value), c AS (SELECT label, count(*) FILTER (WHERE value = 1) AS positive, count(*) AS total FROM l GROUP BY label) SELECT label, positive, total - positive AS negative, total, round(positive / total * 100, 6) AS positive_pct, round((total - positive) / positive, 6) AS ratio, coalesce((total - positive) / nullif(positive, 0) > 20, true) AS imbalanced FROM c", log=False)
def imbalance_report(spark, sf_dir):
    r = mlprep.imbalance_report(_labelled(spark, sf_dir), ["quality", "toxic"])
    return r.withColumns({"positive_pct": _r("positive_pct", "x"), "ratio": _r("ratio", "x")})


ORDER_SQL = "ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id"


@query(LABELLED_SQL + f", p AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality {ORDER_SQL}) - 1) / count(*) OVER (PARTITION BY quality) AS place FROM d) SELECT doc_id, CASE WHEN place < 0.7::DOUBLE THEN 'train' WHEN place < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split FROM p", log=False)
def stratified_split(spark, sf_dir):
    return mlprep.stratified_split(_labelled(spark, sf_dir), "quality", "doc_id").select("doc_id", "split")


@query(LABELLED_SQL + f"SELECT doc_id, ((row_number() OVER (PARTITION BY quality {ORDER_SQL}) - 1) % 5)::INT AS fold FROM d", log=False)
def stratified_folds(spark, sf_dir):
    return mlprep.stratified_folds(_labelled(spark, sf_dir), "quality", "doc_id").select("doc_id", "fold")


@query("SELECT round(skewness(n_chars::DOUBLE), 6) AS chars, round(skewness(len(text)::DOUBLE), 6) AS lengths FROM documents", log=False)
def bias_corrected_skew(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("n"), F.length("text").cast("double").alias("k"))
    return d.agg(_r(mlprep.skew("n"), "chars"), _r(mlprep.skew("k"), "lengths"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, ln(1 + greatest(l_extendedprice, 0)) AS p, l_extendedprice AS e FROM lineitem), s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(e) AS me, stddev_pop(e) AS se FROM l)
SELECT l_orderkey, l_linenumber, round((q - mq) / sq, 6) AS q, round((e - me) / se, 6) AS e FROM l, s""", log=False)
def standard_scale(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    scaled = mlprep.scale(rows, mlprep.fit_scaler(rows, ["q", "e"]))
    return scaled.select("l_orderkey", "l_linenumber", _r("q", "q"), _r("e", "e"))


@query(LABELLED_SQL + "SELECT 'n_chars' AS feature, 'quality' AS label, round(corr(n_chars, quality), 6) AS corr FROM d UNION ALL SELECT 'odd', 'quality', round(corr(odd, quality), 6) FROM d UNION ALL SELECT 'n_chars', 'toxic', round(corr(n_chars, toxic), 6) FROM d UNION ALL SELECT 'odd', 'toxic', round(corr(odd, toxic), 6) FROM d", log=False)
def leakage_correlations(spark, sf_dir):
    return mlprep.correlations(_labelled(spark, sf_dir), ["n_chars", "odd"], ["quality", "toxic"]).withColumn("corr", _r("corr", "corr"))


# --- metrics

SCORED_SQL = LABELLED_SQL.rstrip() + ", s AS (SELECT doc_id, quality AS label, (odd < 50)::INT AS prediction, odd / 97 AS score FROM d)\n"


def _scored(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", F.col("quality").alias("label"), (F.col("odd") < 50).cast("int").alias("prediction"), (F.col("odd") / 97).alias("score"))


@query(SCORED_SQL + """, c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1, round(tp / (tp + fp), 6) AS positive_precision, round(tp / (tp + fn), 6) AS positive_recall FROM c""", log=False)
def binary_metrics(spark, sf_dir):
    m = metrics.binary_metrics(_scored(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", _r("accuracy", "accuracy"), _r("f1", "f1"), _r("positive_precision", "positive_precision"), _r("positive_recall", "positive_recall"))


@query(SCORED_SQL + """, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY score), w AS (SELECT *, sum(pos) OVER k AS cp, sum(neg) OVER k AS cn FROM g WINDOW k AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(neg * (cp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision FROM w""", log=False)
def ranking_metrics(spark, sf_dir):
    m = metrics.ranking_metrics(_scored(spark, sf_dir))
    return m.select(_r("roc_auc", "roc_auc"), _r("average_precision", "average_precision"))


@query(LABELLED_SQL.rstrip() + """, s AS (SELECT 'quality' AS name, quality AS label, (odd < 50)::INT AS prediction FROM d UNION ALL SELECT 'toxic', toxic, (odd < 20)::INT FROM d),
c AS (SELECT name, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM s GROUP BY name)
SELECT count(*) AS labels, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 6) AS macro_precision, round(avg(tp / (tp + fn)), 6) AS macro_recall FROM c""", log=False)
def multilabel_metrics(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    part = lambda name, at: d.select(F.lit(name).alias("name"), F.col(name).alias("label"), (F.col("odd") < at).cast("int").alias("prediction"))
    m = metrics.multilabel_metrics(part("quality", 50).unionByName(part("toxic", 20)))
    return m.select("labels", _r("macro_f1", "macro_f1"), _r("macro_precision", "macro_precision"), _r("macro_recall", "macro_recall"))


@query(SCORED_SQL + "SELECT count(*) AS total, round(avg((label = 0)::INT), 6) AS accuracy, 0.0::DOUBLE AS recall FROM s", log=False)
def always_negative(spark, sf_dir):
    return metrics.always_negative(_scored(spark, sf_dir)).withColumn("accuracy", _r("accuracy", "accuracy"))


@query(SCORED_SQL + ", f AS (SELECT doc_id % 5 AS fold, avg((label = prediction)::INT) AS value FROM s GROUP BY 1) SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM f", log=False)
def fold_statistics(spark, sf_dir):
    each = _scored(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("fold"), F.lit("accuracy").alias("metric")).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("value"))
    return metrics.over_folds(each, ["metric"]).select(_r("mean", "mean"), _r("std", "std"))


# --- evaluation

ENGAGE_SQL = PAIRS_SQL + """, v AS (SELECT conv_id, count(*)::DOUBLE AS n, sum(length(instruction))::DOUBLE AS dur, (conv_id % 10) / 10 AS quality, conv_id % 3 = 0 AS flagged FROM pairs GROUP BY conv_id),
x AS (SELECT *, n * (1 + quality * factor) AS ln, n * (1 + quality * factor) * (dur / n) AS ld FROM v, (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS factor) WHERE n > 0 AND dur > 0),
y AS (SELECT *, CASE WHEN abs(ld - dur) > 1e-6 THEN (ln - n) / (ld - dur) ELSE 0 END AS aei FROM x)
"""


@query(ENGAGE_SQL + "SELECT factor, flagged, count(*) AS sessions, round(avg(aei), 6) AS mean_aei, round(median(aei), 6) AS median_aei, round(min(aei), 6) AS min_aei, round(max(aei), 6) AS max_aei, round((sum(ln) - sum(n)) / greatest(sum(n), 1) * 100, 6) AS command_increase_pct, round((sum(ld) - sum(dur)) / greatest(sum(dur), 0.01) * 100, 6) AS duration_increase_pct FROM y GROUP BY 1, 2", log=False)
def engagement_sensitivity(spark, sf_dir):
    s = _pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").cast("double").alias("n"), F.sum(F.length("instruction")).cast("double").alias("dur"))
    rows = evaluation.engagement(s.withColumns({"quality": (F.col("conv_id") % 10) / 10, "flagged": F.col("conv_id") % 3 == 0}))
    e = evaluation.engagement_summary(rows, ["factor", "flagged"])
    return e.select("factor", "flagged", "sessions", *(_r(c, c) for c in ("mean_aei", "median_aei", "min_aei", "max_aei", "command_increase_pct", "duration_increase_pct")))


@query("SELECT lang, count(*) AS samples, count(*) FILTER (WHERE f1 >= 0.75) AS consistent, count(*) FILTER (WHERE f1 < 0.45) AS semantic, count(*) FILTER (WHERE leak) AS leaked, count(*) FILTER (WHERE f1 < 0.45 OR leak) AS hallucinated, round(avg(f1), 6) AS mean_f1, round(avg(f1) FILTER (WHERE NOT (f1 < 0.45 OR leak)), 6) AS mean_f1_of_rest FROM (SELECT lang, (n_chars % 100) / 100 AS f1, CASE WHEN doc_id % 5 = 0 THEN text || ' Please note that' ELSE text END AS t, regexp_matches(t, '(?i)" + LEAKS.replace("'", "''") + "') AS leak FROM documents) GROUP BY 1", log=False)
def quality_rates(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" Please note that"))).otherwise(F.col("text")).alias("text"), ((F.col("n_chars") % 100) / 100).alias("f1"))
    q = evaluation.quality_rates(s, ["lang"], "text")
    return q.select("lang", "samples", "consistent", "semantic", "leaked", "hallucinated", _r("mean_f1", "mean_f1"), _r("mean_f1_of_rest", "mean_f1_of_rest"))


@query(PAIRS_SQL + """, w AS (SELECT conv_id, pair, unnest(list_filter(string_split_regex(lower(instruction), '\\s+'), lambda x: x <> '')) AS g FROM pairs), v AS (SELECT conv_id, pair, unnest(list_filter(string_split_regex(lower(output), '\\s+'), lambda x: x <> '')) AS g FROM pairs),
a AS (SELECT conv_id, pair, g, count(*) AS r FROM w GROUP BY ALL), b AS (SELECT conv_id, pair, g, count(*) AS h FROM v GROUP BY ALL),
j AS (SELECT conv_id, pair, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM a FULL JOIN b USING (conv_id, pair, g))
SELECT conv_id * 1000 + pair AS sample, sum(least(r, h))::BIGINT AS matched, round(2 * sum(least(r, h)) / (sum(r) + sum(h)), 6) AS f1 FROM j GROUP BY 1""", log=False)
def word_overlap(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("sample", F.col("conv_id") * 1000 + F.col("pair"))
    return evaluation.overlap(p, "sample", 1, "instruction", "output").select("sample", "matched", _r("f1", "f1"))


@query(PAIRS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT conv_id, pair, list_filter(string_split_regex(lower(instruction), '\\s+'), lambda x: x <> '') AS xs, list_filter(string_split_regex(lower(output), '\\s+'), lambda x: x <> '') AS ys FROM pairs),
c AS (SELECT *, list_filter(xs, lambda x: list_contains(ys, x)) AS cx, list_filter(ys, lambda x: list_contains(xs, x)) AS cy FROM t),
x AS (SELECT conv_id, pair, unnest(cx) AS word, unnest(range(1, len(cx) + 1)) AS i FROM c), y AS (SELECT conv_id, pair, unnest(cy) AS word, unnest(range(1, len(cy) + 1)) AS j FROM c),
d AS (SELECT conv_id, pair, word, j, 0::BIGINT AS i, 0::BIGINT AS v FROM y
  UNION ALL SELECT conv_id, pair, word, j, i, max(greatest(v, CASE WHEN same THEN before + 1 ELSE 0 END)) OVER (PARTITION BY conv_id, pair ORDER BY j) AS v
  FROM (SELECT d.conv_id, d.pair, d.word, d.j, d.i + 1 AS i, d.v, x.word = d.word AS same, lag(d.v, 1, 0) OVER (PARTITION BY d.conv_id, d.pair ORDER BY d.j) AS before
    FROM d JOIN x ON x.conv_id = d.conv_id AND x.pair = d.pair AND x.i = d.i + 1))
SELECT t.conv_id, t.pair, coalesce(max(v), 0) AS lcs, round(CASE WHEN len(xs) + len(ys) > 0 THEN 2 * coalesce(max(v), 0) / (len(xs) + len(ys)) ELSE 0 END, 6) AS rouge_l
FROM t LEFT JOIN d ON d.conv_id = t.conv_id AND d.pair = t.pair GROUP BY t.conv_id, t.pair, xs, ys""", log=False)
def common_subsequence(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return evaluation.longest_common(p, "instruction", "output").select("conv_id", "pair", "lcs", _r("rouge_l", "rouge_l"))


@query("WITH c AS (SELECT request_data AS command, id FROM log WHERE event_type = 'ssh_command'), f AS (SELECT DISTINCT src_ip FROM log WHERE request_data = 'rm -rf /tmp/x') SELECT l.id, f.src_ip IS NOT NULL AS flagged FROM log l LEFT JOIN f ON l.src_ip = f.src_ip".replace("WITH c", ", c", 1))
def existence_flag(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return evaluation.with_flag(log, log.where("request_data = 'rm -rf /tmp/x'"), "src_ip").select("id", "flagged")


@query("SELECT vec_id, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 5) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)", log=False)
def vector_cosine(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", _r(evaluation.cosine(F.col("embedding"), F.col("q")), "cosine", 5))  # one row


# --- raw records

#: Events as the SSH sensor would write them.
RAW_IDS = {"ssh_command": "cowrie.command.input", "ssh_login_failed": "cowrie.login.failed", "ssh_login_success": "cowrie.login.success", "ssh_file_downloaded": "cowrie.session.file_download"}


def _raw(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in RAW_IDS.items() for x in kv))
    log = event_log(spark, sf_dir)
    fields = F.struct(
        F.coalesce(names[F.col("event_type")], F.lit("cowrie.other.thing")).alias("eventid"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.when(F.col("id") % 7 != 0, F.col("src_ip")).alias("src_ip"),
        F.when(F.col("id") % 14 == 0, F.col("src_ip")).alias("peer_ip"), F.col("dest_port").alias("dst_port"), F.col("session_id").alias("session"), "username", "password", F.col("request_data").alias("input"), F.col("id").cast("string").alias("message"),
    )
    return log.select(F.when(F.col("id") % 50 == 0, "no json").otherwise(F.to_json(fields)).alias("value"))


@query("""SELECT CASE event_type WHEN 'http_request' THEN 'unknown' ELSE event_type END AS event_type, CASE WHEN id % 7 <> 0 OR id % 14 = 0 THEN src_ip END AS src_ip, CASE WHEN dest_port = 0 THEN 22 ELSE dest_port END AS dest_port, 'ssh' AS protocol, session_id, username, password,
 coalesce(request_data, id::VARCHAR) AS request_data, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS time FROM log WHERE id % 50 <> 0""")
def normalize_ssh_events(spark, sf_dir):
    e = normalize.normalize_ssh(_raw(spark, sf_dir))
    return e.select("event_type", "src_ip", "dest_port", "protocol", "session_id", "username", "password", "request_data", F.date_format(F.to_timestamp_ntz(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))


@query("SELECT CASE WHEN id % 7 <> 0 OR id % 14 = 0 THEN '' ELSE 'src_ip' END AS missing_field, count(*) AS cnt FROM log WHERE id % 50 <> 0 GROUP BY 1")
def validation_counts(spark, sf_dir):
    e = normalize.normalize_ssh(_raw(spark, sf_dir))
    return e.groupBy(F.coalesce(normalize.missing_field(e), F.lit("")).alias("missing_field")).agg(F.count("*").alias("cnt"))


IDS_SQL = "SELECT id::VARCHAR AS session_id, CASE WHEN id % 3 = 0 THEN 'h.example' ELSE '' END || CASE WHEN http_uri IS NULL THEN '' ELSE http_uri END AS uri, severity FROM log WHERE id % 5 <> 0"


@query(f"SELECT session_id, nullif(uri, '') AS http_uri, severity FROM ({IDS_SQL})")
def normalize_ids_events(spark, sf_dir):
    log = event_log(spark, sf_dir)
    http = F.struct(F.when(F.col("id") % 3 == 0, "h.example").alias("hostname"), F.col("http_uri").alias("url"))
    kind = F.when(F.col("id") % 5 == 0, "stats").otherwise("flow")
    raw = log.select(F.to_json(F.struct(kind.alias("event_type"), F.col("id").alias("flow_id"), http.alias("http"), F.struct(F.lit("x").alias("signature"), "severity").alias("alert"))).alias("value"))
    return normalize.normalize_ids(raw).select("session_id", "http_uri", "severity")


@query(PAIRS_SQL + "SELECT * FROM pairs", log=False)
def terminal_pairs(spark, sf_dir):
    """Conversations as binary terminal recordings, decoded and paired again."""
    from ..sources import terminal

    word = lambda n: F.concat(*(F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)))
    side = F.when(F.col("role") == "user", terminal.INPUT).otherwise(terminal.OUTPUT)
    raw = F.encode("text", "UTF-8")
    head = F.concat(word(F.lit(terminal.DATA)), word(F.lit(0)), word(F.octet_length(raw)), word(side), word(F.lit(0)), word(F.lit(0)))
    turns = _t(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", F.concat(head, F.hex(raw)).alias("h"))
    content = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), ""))
    return terminal.pairs(turns.groupBy("conv_id").agg(content.alias("content")), "conv_id")


# --- models and streams: no SQL


def _learnable(spark, sf_dir):
    # Figures come before the join, so that no text is shuffled.
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.length("text"), F.lit(1))
    lines = F.regexp_count("text", F.lit("\n")) + 1
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), share(r"[#*$%&|]").alias("symbols"), share("[A-Z]").alias("capitals"), lines.cast("double").alias("lines"))
    return d.join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars", "symbols", "capitals", "lines")


MODEL_FEATURES = ["n_chars", "symbols", "capitals", "lines"]


@query()
def train_models(spark, sf_dir):
    from ..operators import train

    return train.evaluate(mlprep.stratified_split(_learnable(spark, sf_dir), "quality", "doc_id"), MODEL_FEATURES, ["quality", "toxic"], ["lr", "rf", "gbt"])


@query()
def cross_validation(spark, sf_dir):
    from ..operators import train

    return train.cross_validate(_learnable(spark, sf_dir), MODEL_FEATURES, "quality", "doc_id", "rf", folds=5)


@query()
def isolation_forest(spark, sf_dir):
    from ..operators import anomaly

    rows = _learnable(spark, sf_dir).withColumn("label", 1 - F.col("quality"))
    forest = anomaly.fit(rows.where("label = 0"), MODEL_FEATURES, "doc_id")
    scores = anomaly.score(rows, forest, MODEL_FEATURES)
    return metrics.anomaly_summary(anomaly.flagged(scores.where("label = 0"), scores))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions look scripted: sessions, timing, automation profile, the busiest first."""
    return _automation(spark, sf_dir).select("session", "event_count", "automation_score", "automation_likelihood").orderBy(F.col("event_count").desc(), "session").limit(100)


from . import more, stores, streams  # noqa: E402, F401  add their queries
