"""More queries over the driver's tables: operators that no query of ``registry`` exercises, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluation, metrics, mlprep, normalize, sessions, soc, train
from .driver_log import WIDE_SQL, event_log, wide_log
from .registry import GEO_SQL, LABELLED_SQL, PAIRS_SQL, _geo, _labelled, _pairs, _r, _t, _time, query
from .stated import LEAKS, SUSPECTS

# --- raw records


@query("""SELECT CASE WHEN id % 4 = 1 THEN 'ev' WHEN event_type = 'http_request' THEN 'http' WHEN event_type LIKE '%login%' THEN 'ftp' ELSE 'tcp' END AS event_type, src_ip, dest_port AS src_port, dest_ip, CASE WHEN id % 2 = 0 THEN 80 ELSE 81 END AS dest_port,
 CASE WHEN event_type = 'http_request' THEN 'HTTP' WHEN event_type LIKE '%login%' THEN 'FTP' END AS protocol, CASE WHEN event_type = 'http_request' OR event_type LIKE '%login%' THEN session_id END AS session_id,
 CASE WHEN event_type LIKE '%login%' AND id % 2 = 0 THEN username END AS username, CASE WHEN event_type LIKE '%login%' AND id % 2 = 1 THEN password END AS password,
 CASE WHEN event_type = 'http_request' THEN 'p' || id WHEN event_type LIKE '%login%' THEN CASE WHEN id % 2 = 0 THEN 'USER ' || username || ' ' ELSE 'PASS ' || password END END AS request_data,
 CASE WHEN event_type = 'http_request' THEN 'GET' END AS http_method, CASE WHEN event_type = 'http_request' THEN http_uri END AS http_uri, CASE WHEN event_type = 'http_request' THEN 'UA/' || (id % 3) END AS http_user_agent, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS time
 FROM log WHERE id % 11 <> 0 AND id % 17 <> 0""")
def normalize_service_events(spark, sf_dir):
    i, kind = F.col("id"), F.col("event_type")
    web, login = kind == "http_request", kind.contains("login")
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    some = lambda condition, value, name: F.when(condition, value).alias(name)
    fields = F.struct(
        F.when(i % 11 == 0, "heartbeat").when(web, "http").when(login, "ftp").otherwise("tcp").alias("category"), some(i % 17 == 0, "info", "type"), some(i % 4 == 1, "ev", "event"),
        some(i % 3 == 0, time, "date"), some(i % 3 == 1, time, "@timestamp"), some(i % 3 == 2, time, "time"), some(i % 2 == 0, F.col("src_ip"), "source-ip"), some(i % 2 == 1, F.col("src_ip"), "src"),
        F.col("dest_port").cast("string").alias("sport"), F.col("dest_ip").alias("destination-ip"), F.when(i % 2 == 0, "80").otherwise("81").alias("destination-port"), F.col("session_id").alias("http.sessionid"), F.col("session_id").alias("ftp.sessionid"),
        F.lit("GET").alias("http.method"), F.col("http_uri").alias("http.url"), F.array(F.concat(F.lit("UA/"), (i % 3).cast("string")), F.lit("UA/other")).alias("http.header.user-agent"), F.concat(F.lit("p"), i.cast("string")).alias("payload-hex"),
        F.when(i % 2 == 0, F.concat(F.lit("USER "), "username", F.lit(" "))).otherwise(F.concat(F.lit("PASS "), "password")).alias("ftp.command"),
    )
    e = normalize.normalize_service(event_log(spark, sf_dir).select(F.to_json(fields).alias("value")))
    wanted = ["event_type", "src_ip", "src_port", "dest_ip", "dest_port", "protocol", "session_id", "username", "password", "request_data", "http_method", "http_uri", "http_user_agent"]
    return e.select(*wanted, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time")).withColumn("src_port", F.coalesce("src_port", F.lit(0)))


@query("""SELECT log_source, count(*) AS cnt, count(DISTINCT event_type) AS event_types FROM (SELECT 'cowrie' AS log_source, 'unknown' AS event_type FROM log UNION ALL SELECT 'honeytrap', 'tcp' FROM log UNION ALL SELECT 'suricata', CASE WHEN id % 2 = 0 THEN 'flow' ELSE 'alert' END FROM log) GROUP BY 1""")
def merged_sensors(spark, sf_dir):
    log = event_log(spark, sf_dir)
    raw = lambda **fields: log.select(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))
    sources = {"cowrie": raw(eventid=F.lit("none such")), "honeytrap": raw(category=F.lit("tcp")), "suricata": raw(event_type=F.when(F.col("id") % 2 == 0, "flow").otherwise("alert"))}
    return normalize.merged(sources).groupBy("log_source").agg(F.count("*").alias("cnt"), F.countDistinct("event_type").alias("event_types"))


@query("""SELECT id::VARCHAR AS id, CASE WHEN id % 10 <> 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') END AS time, CASE WHEN id % 7 = 0 THEN -1 ELSE dest_port END AS dest_port, severity, coalesce(username, '') AS username, coalesce(request_data, '') AS request_data FROM log""")
def typed_events(spark, sf_dir):
    i, log = F.col("id"), event_log(spark, sf_dir)
    time = F.when(i % 10 == 0, "no time").when(i % 2 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text = log.select(i.cast("string").alias("id"), time.alias("timestamp"), F.when(i % 7 == 0, "x1").otherwise(F.col("dest_port").cast("string")).alias("dest_port"), F.col("severity").cast("string").alias("severity"), "username", "request_data")
    return normalize.typed(text).select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.coalesce("dest_port", F.lit(-1)).alias("dest_port"), "severity", "username", "request_data")


# --- sessions and answers


@query(""", u AS (SELECT session_id AS session, request_data AS v, min(timestamp) AS t, arg_min(id, (timestamp, id)) AS i FROM log WHERE session_id <> '' AND request_data <> '' GROUP BY ALL),
g AS (SELECT session, floor((epoch_us(t) - epoch_us(lag(t) OVER k)) / 1000) / 1000.0 AS delay FROM u WINDOW k AS (PARTITION BY session ORDER BY t, i)),
d AS (SELECT session, coalesce(avg(delay), 0) AS avg_delay, coalesce(max(delay), 0) AS max_delay FROM g GROUP BY session),
c AS (SELECT session_id AS session, coalesce(request_data, '') AS v, min(timestamp) AS t, arg_min(id, (timestamp, id)) AS i FROM log WHERE session_id <> '' GROUP BY ALL), j AS (SELECT session, string_agg(v, '|' ORDER BY t, i) AS commands FROM c GROUP BY session)
SELECT l.session_id AS session, count(*) AS event_count, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS end_time, arg_min(src_ip, (timestamp, id)) AS src_ip, round(max(coalesce(avg_delay, 0)), 6) AS avg_delay, round(max(coalesce(max_delay, 0)), 6) AS max_delay, max(commands) AS commands
 FROM log l LEFT JOIN d ON d.session = l.session_id LEFT JOIN j ON j.session = l.session_id WHERE session_id <> '' GROUP BY 1""")
def sensor_session_lists(spark, sf_dir):
    s = sessions.sensor_sessions(event_log(spark, sf_dir))
    return s.select("session", "event_count", _time("start_time"), _time("end_time"), "src_ip", _r("avg_inter_cmd_delay", "avg_delay"), _r("max_inter_cmd_delay", "max_delay"), F.array_join("commands", "|").alias("commands"))


@query("SELECT count(*) AS row_count, count(*) > 0 AS present FROM log")
def health(spark, sf_dir):
    return soc.health(event_log(spark, sf_dir))


@query("SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, log_source, event_type, src_ip, dest_ip, dest_port, protocol, session_id, username, request_data FROM log ORDER BY log.timestamp DESC, id DESC LIMIT 1000")
def latest_in_time(spark, sf_dir):
    return soc.answer(soc.latest_in_time(event_log(spark, sf_dir)), soc.LOG_COLUMNS).withColumn("timestamp", _time("timestamp"))


ONE = "one AS (SELECT * FROM log WHERE session_id = (SELECT min(session_id) FROM log WHERE event_type = 'ssh_command'))"


@query(f""", {ONE}, t AS (SELECT 'timeline' AS part, event_type AS a, coalesce(request_data, '') AS b, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS c FROM one ORDER BY timestamp, id LIMIT 500),
p AS (SELECT 'credentials', coalesce(username, ''), coalesce(password, ''), '' FROM (SELECT DISTINCT username, password FROM one WHERE username <> '' OR password <> '') ORDER BY username, password LIMIT 50),
k AS (SELECT 'commands', request_data, cnt::VARCHAR, strftime(first_at, '%Y-%m-%d %H:%M:%S.%f') FROM (SELECT request_data, count(*) AS cnt, min(timestamp) AS first_at, arg_min(id, (timestamp, id)) AS i FROM one WHERE request_data <> '' GROUP BY 1) ORDER BY first_at, i LIMIT 100)
SELECT * FROM t UNION ALL SELECT * FROM p UNION ALL SELECT * FROM k UNION ALL SELECT 'summary', count(*)::VARCHAR, count(DISTINCT request_data) FILTER (WHERE request_data <> '')::VARCHAR, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') FROM one""")
def session_page(spark, sf_dir):
    """All parts of the page on one session, the first that has a command."""
    log = event_log(spark, sf_dir)
    wanted = log.where("event_type = 'ssh_command'").agg(F.min("session_id")).first()[0]
    page = soc.session_answer(log, wanted)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = lambda part, a, b, c: page[part].select(F.lit(part).alias("part"), text(a).alias("a"), text(b).alias("b"), (_time(c) if c else F.lit("")).alias("c"))
    return row("timeline", "event_type", "request_data", "timestamp").unionByName(row("credentials", "username", "password", None)).unionByName(row("commands", "request_data", "cnt", "first_seen")).unionByName(row("summary", "total_events", "requests", "end_time"))


@query("SELECT session_id, event_type, count(*) AS cnt FROM log WHERE session_id <> '' GROUP BY ALL")
def session_event_types(spark, sf_dir):
    return soc.session_types(event_log(spark, sf_dir))


@query("SELECT DISTINCT session_id FROM log WHERE session_id IS NOT NULL")
def session_ids(spark, sf_dir):
    return soc.session_ids(event_log(spark, sf_dir))


@query(GEO_SQL + "SELECT query, country, org FROM geo WHERE query::VARCHAR LIKE '%7%'")
def place_search(spark, sf_dir):
    return soc.places(_geo(spark, sf_dir).withColumn("query", F.col("query").cast("string")), "7").select(F.col("query").cast("long").alias("query"), "country", "org")


# --- labels, models and metrics


@query(LABELLED_SQL + "SELECT 'quality' AS label, count(*) FILTER (WHERE quality = 1) AS positive FROM d UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 1) FROM d UNION ALL SELECT 'unlabelled', count(*) FILTER (WHERE quality = 0 AND toxic = 0) FROM d", log=False)
def label_prevalence(spark, sf_dir):
    return mlprep.prevalence(_labelled(spark, sf_dir), ["quality", "toxic"])


@query("WITH x AS (SELECT lang AS feature, source, avg(n_chars) / 1000 AS importance FROM documents GROUP BY ALL HAVING count(*) > 2) SELECT feature, round(sum(importance) / (SELECT count(DISTINCT source) FROM documents), 6) AS importance FROM x GROUP BY 1", log=False)
def mean_importances(spark, sf_dir):
    """Importances of languages for sources, some of them missing, averaged over all sources."""
    d = _t(spark, sf_dir, "documents")
    each = d.groupBy(F.col("lang").alias("feature"), "source").agg((F.avg("n_chars") / 1000).alias("importance"), F.count("*").alias("n")).where("n > 2")
    return train.mean_importances(each, d.select("source").distinct().count()).select("feature", _r("importance", "importance"))


@query(LABELLED_SQL.rstrip() + ", s AS (SELECT toxic AS label, (odd > 80)::INT AS prediction, odd / 97 AS score FROM d) SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(prediction), 6) AS flagged FROM s GROUP BY 1", log=False)
def anomaly_rates(spark, sf_dir):
    scored = _labelled(spark, sf_dir).select(F.col("toxic").alias("label"), (F.col("odd") > 80).cast("int").alias("prediction"), (F.col("odd") / 97).alias("score"))
    return metrics.anomaly_summary(scored).select("label", "n", *(_r(c, c) for c in ("mean", "min", "max", "flagged")))


@query("SELECT arg_max(lang, (f1, -place)) AS model FROM (SELECT lang, round(avg(n_chars % 3), 1) AS f1, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS place FROM documents WHERE lang IS NOT NULL GROUP BY 1)", log=False)
def best_model(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("lang").alias("model")).agg(F.round(F.avg(F.col("n_chars") % 3), 1).alias("f1"))
    return metrics.best_model(d, ["en", "de", "fr", "es"])


@query(LABELLED_SQL + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE odd END AS value FROM d", log=False)
def cleaned_features(spark, sf_dir):
    """Missing, infinite and no-number values, made from the table's numbers, become 0."""
    bad = F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 9 == 3, F.lit(float("inf"))).when(F.col("doc_id") % 9 == 6, F.lit(None).cast("double"))
    rows = _labelled(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, bad).otherwise(F.col("odd")).alias("value"))
    return mlprep.cleaned(rows, ["value"]).select("doc_id", "value")


@query("WITH a AS (SELECT count(*) AS docs, round(avg(n_chars), 6) AS mean FROM documents), b AS (SELECT count(*) AS docs, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels) SELECT a.docs, a.mean, b.docs AS docs_labels, b.toxic FROM a, b", log=False)
def stitched_figures(spark, sf_dir):
    first = _t(spark, sf_dir, "documents").agg(F.count("*").alias("docs"), _r(F.avg("n_chars"), "mean"))
    second = _t(spark, sf_dir, "labels").agg(F.count("*").alias("docs"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return evaluation.stitched(first, second, "_labels")


# --- corpus and texts


@query(PAIRS_SQL + """, r AS (SELECT trim(instruction) AS command, arg_max(trim(output), conv_id * 1000 + pair) AS reference FROM pairs WHERE trim(instruction) <> '' AND trim(output) <> '' GROUP BY 1),
t AS (SELECT conv_id, turn, trim(text) AS command, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'),
hit AS (SELECT conv_id, turn, command, reference FROM t JOIN r USING (command) WHERE place <= 10)
SELECT hit.*, (SELECT count(DISTINCT conv_id) FROM hit) AS sessions FROM hit""", log=False)
def reference_matches(spark, sf_dir):
    """The first ten questions of each conversation, those that the corpus has an answer to, and how many conversations have one."""
    pairs = _pairs(spark, sf_dir).withColumn("ord", F.col("conv_id") * 1000 + F.col("pair"))
    reference = evaluation.reference_answers(pairs)
    turns = _t(spark, sf_dir, "conversations")
    asked = evaluation.first_commands(turns.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("command")), "conv_id", "turn", 10)
    some = evaluation.with_any_match(turns.select("conv_id").distinct(), asked, reference, "conv_id").agg(F.count("*").alias("sessions"))
    return evaluation.matched(asked, reference).select("conv_id", "turn", "command", "reference").crossJoin(F.broadcast(some))  # one row


@query(PAIRS_SQL + """, u AS (SELECT 'pairs' AS name, trim(instruction) AS i, output AS o FROM pairs UNION ALL SELECT 'benchmark', trim(text), text FROM benchmark UNION ALL SELECT 'again', trim(instruction), CASE WHEN pair % 2 = 0 THEN '' ELSE output END FROM pairs)
SELECT name, count(*) AS parsed, count(*) FILTER (WHERE i = '' OR o = '') AS skipped, count(DISTINCT i) FILTER (WHERE i <> '' AND o <> '') AS different FROM u GROUP BY 1""", log=False)
def corpus_sizes(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("instruction", "output", "pair")
    b = _t(spark, sf_dir, "benchmark").select(F.col("text").alias("instruction"), F.col("text").alias("output"))
    again = p.withColumn("output", F.when(F.col("pair") % 2 == 0, "").otherwise(F.col("output")))
    return corpus.sizes({"pairs": p, "benchmark": b, "again": again})


@query(PAIRS_SQL + """SELECT conv_id, pair, '<|system|>' || chr(10) || 'You are a shell' || '<|end|>' || chr(10) || '<|user|>' || chr(10) || instruction || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || output || '<|end|>' AS example, instruction || ' [SEP] ' || output AS masked, trim(output) AS answer FROM pairs""", log=False)
def training_texts(spark, sf_dir):
    """Training examples, masked texts, and answers cut out of generated text again."""
    p = _pairs(spark, sf_dir)
    system = F.lit("You are a shell")
    prompt = T.template(system, F.col("instruction"))
    masked = corpus.masked_text(p.select("instruction", "output")).distinct()
    out = p.select("conv_id", "pair", T.template(system, F.col("instruction"), F.col("output")).alias("example"), F.concat("instruction", F.lit(" [SEP] "), "output").alias("text"), T.without_prompt(F.concat(prompt, "output", F.lit("<|end|>")), prompt).alias("answer"))
    return out.join(masked, "text").select("conv_id", "pair", "example", F.col("text").alias("masked"), "answer")


@query("SELECT conv_id, turn, regexp_matches(t, '(?i)" + LEAKS.replace("'", "''") + "') AS leaks, regexp_matches(t, '(?i)" + SUSPECTS + "') AS suspicious, CASE WHEN length(t) % 100 >= 75 THEN 'high' WHEN length(t) % 100 >= 55 THEN 'middle' ELSE 'low' END AS band FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || ' I''m sorry' WHEN 1 THEN 'wget x; ' || text ELSE text END AS t FROM conversations)", log=False)
def text_marks(spark, sf_dir):
    turn, text = F.col("turn") % 4, F.col("text")
    t = F.when(turn == 0, F.concat(text, F.lit(" I'm sorry"))).when(turn == 1, F.concat(F.lit("wget x; "), text)).otherwise(text)
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", T.leaks(F.col("t")).alias("leaks"), T.suspicious(F.col("t")).alias("suspicious"), evaluation.band(F.length("t") % 100 / 100).alias("band"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS cleaned FROM conversations", log=False)
def cleaned_inputs(spark, sf_dir):
    """Texts with colours and mistypings put in, cleaned again."""
    noisy = F.concat(F.lit("\x1b[31m\r\n"), "text", F.lit("xy\b\b\x1b[0m\r\n"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_input(noisy).alias("cleaned"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 50", log=False)
def sampled_rows(spark, sf_dir):
    return evaluation.sampled(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@query(WIDE_SQL + "SELECT session_id, list_has_any(flatten(list_transform(list(DISTINCT username) FILTER (username <> ''), lambda u: list_transform(list(DISTINCT password) FILTER (password <> ''), lambda p: u || ':' || p))), ['root:root', 'admin:admin', 'root:123456', 'admin:password', 'test:test', 'root:toor', 'admin:1234', 'root:admin', 'user:user'])::INT AS default_credentials FROM wide WHERE username IS NOT NULL GROUP BY 1")
def default_credentials(spark, sf_dir):
    from ..functions import net

    rows = wide_log(spark, sf_dir).where("username is not null").groupBy("session_id").agg(F.collect_set("username").alias("users"), F.collect_set("password").alias("passwords"))
    return rows.select("session_id", net.default_credentials(F.col("users"), F.col("passwords")).alias("default_credentials"))
