"""Queries that write, read back and answer: stores of events and pairs, sketches, searches, saved models, nested commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import walks
from ..operators import corpus, evaluation, mlprep, normalize, saved_models, sketches, soc
from ..sources import readers, searchable, sinks
from ..sources.shared import new_place as folder
from .driver_log import event_log
from .registry import ENGAGE_SQL, LABELLED_SQL, MODEL_FEATURES, ORDER_SQL, PAIRS_SQL, _labelled, _learnable, _pairs, _r, _time, query
from .stated import SSH_IDS


def _valid_events(spark, sf_dir):
    """The log as events of version 1; those of every 50th number lack their address."""
    source = F.when(F.col("id") % 50 != 0, F.col("src_ip"))
    return event_log(spark, sf_dir).withColumns({"version": F.lit(1), "src_ip": source})


@query("SELECT id, event_type, src_ip, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM log")
def stored_events(spark, sf_dir):
    """Events appended to the table by day, in two goes, and read back."""
    at, log = folder(spark, "events"), event_log(spark, sf_dir)
    for half in (0, 1):
        sinks.append_events(log.where(F.col("id") % 2 == half), at)
    return readers.event_table(spark, at).select("id", "event_type", "src_ip", _time("timestamp"))


@query("SELECT CASE WHEN id % 50 = 0 THEN 'quarantine' ELSE 'table' END AS place, event_type, count(*) AS n FROM log GROUP BY 1, 2 UNION ALL SELECT 'backup', event_type, count(*) FROM log WHERE id % 50 <> 0 GROUP BY 2")
def ingested_events(spark, sf_dir):
    """A batch that is ingested twice, as after a failure: each event once in its place."""
    at, rows = folder(spark, "ingest"), _valid_events(spark, sf_dir)
    for _ in range(2):
        sinks.ingest_batch(at)(rows, 0)
    table, spare, bad = spark.read.parquet(f"{at}/table"), spark.read.json(f"{at}/backup"), spark.read.json(f"{at}/quarantine")
    places = [df.select(F.lit(name).alias("place"), "event_type") for name, df in (("table", table), ("backup", spare), ("quarantine", bad))]
    return places[0].unionByName(places[1]).unionByName(places[2]).groupBy("place", "event_type").agg(F.count("*").alias("n"))


@query(PAIRS_SQL + "SELECT instruction, output FROM pairs", log=False)
def pairs_as_json_lines(spark, sf_dir):
    at = folder(spark, "pairs")
    sinks.json_lines(_pairs(spark, sf_dir).select("instruction", "output"), at)
    return readers.json_lines(spark, at)


@query(LABELLED_SQL + f", p AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality {ORDER_SQL}) - 1) / count(*) OVER (PARTITION BY quality) AS place FROM d) SELECT CASE WHEN place < 0.7::DOUBLE THEN 'train' WHEN place < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split, quality, count(*) AS n FROM p GROUP BY 1, 2", log=False)
def saved_splits(spark, sf_dir):
    """Splits written beside the lists of their columns; both are read to count by the label."""
    at = folder(spark, "splits")
    sinks.save_splits(mlprep.stratified_split(_labelled(spark, sf_dir), "quality", "doc_id"), ["doc_id"], ["quality"], at)
    labels = spark.read.text(f"{at}/label_columns").select(F.from_json("value", "array<string>").alias("l")).first().l
    return spark.read.parquet(f"{at}/rows").groupBy("split", *labels).agg(F.count("*").alias("n"))


@query(ENGAGE_SQL + "SELECT factor::VARCHAR AS factor, unnest(['mean', 'median']) AS metric, unnest([round(avg(aei), 6), round(median(aei), 6)]) AS value FROM y GROUP BY 1", log=False)
def reported_engagement(spark, sf_dir):
    """Engagement by factor written as a document of maps, and read as results."""
    at = folder(spark, "results")
    s = _pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").cast("double").alias("n"), F.sum(F.length("instruction")).cast("double").alias("dur"))
    rows = evaluation.engagement(s.withColumn("quality", (F.col("conv_id") % 10) / 10))
    by_factor = evaluation.engagement_summary(rows, ["factor"]).select(F.col("factor").cast("string").alias("f"), F.create_map(F.lit("mean"), "mean_aei", F.lit("median"), "median_aei").alias("m"))
    whole = by_factor.agg(F.map_from_entries(F.collect_list(F.struct("f", "m"))).alias("engagement"))  # a few factors
    sinks.report(whole, at)
    return readers.evaluation_results(spark, at).select("factor", "metric", _r("value", "value"))


@query("SELECT log_source, count(DISTINCT session_id) AS sessions, true AS near FROM log WHERE timestamp >= (SELECT max(timestamp)::DATE - 9 FROM log) GROUP BY 1")
def sessions_from_sketches(spark, sf_dir):
    """Sessions of the last ten days from stored sketches of days, beside the exact count: both within three standard errors."""
    at, log = folder(spark, "sketches"), event_log(spark, sf_dir)
    sketches.put_days(sketches.daily_sketches(log), at)
    last = log.agg(F.to_date(F.max("timestamp")).alias("last"))
    first = str(last.select(F.date_sub("last", 9)).first()[0])
    about = sketches.distinct_over(sketches.stored(spark, at), first).select("log_source", F.col("session_id").alias("about"))
    exact = soc.sessions_per_source(log.where(F.to_date("timestamp") >= F.lit(first).cast("date")))
    near = F.abs(F.col("about") - F.col("sessions")) <= sketches.ERROR * F.col("sessions") + 1
    return exact.join(about, "log_source").select("log_source", "sessions", near.alias("near"))


@query("SELECT id, session_id, true AS pruned FROM log WHERE contains(session_id, 'u12') OR contains(src_ip, 'u12')")
def searched_sessions(spark, sf_dir):
    """Rows whose session or address holds a text, from the files whose maps let it through."""
    at = folder(spark, "searchable")
    searchable.save_searchable(event_log(spark, sf_dir).repartitionByRange(16, "session_id"), at, ["session_id", "src_ip"])
    few, every = searchable.files_with(spark, at, ["session_id", "src_ip"], "U12")
    return searchable.search(spark, at, ["session_id", "src_ip"], "U12").select("id", "session_id", F.lit(len(few) < every).alias("pruned"))


@query("SELECT doc_id, true AS same, true AS in_range FROM documents JOIN labels USING (doc_id)", log=False)
def saved_scores(spark, sf_dir):
    """Probabilities of two labels from one pipeline, before it is saved and from what is loaded."""
    at, rows, labels = folder(spark, "models"), _learnable(spark, sf_dir), ["quality", "toxic"]
    pipeline = saved_models.fitted(mlprep.stratified_split(rows, "quality", "doc_id").where("split = 'train'"), MODEL_FEATURES, labels, "lr")
    saved_models.save(pipeline, at)
    scores = lambda p, n: saved_models.probabilities(p, rows, labels).select("doc_id", F.struct("p_quality", "p_toxic").alias(n))
    both = scores(pipeline, "before").join(scores(saved_models.load(at), "after"), "doc_id")
    fits = F.col("before.p_quality").between(0, 1) & F.col("before.p_toxic").between(0, 1)
    return both.select("doc_id", (F.col("before") == F.col("after")).alias("same"), fits.alias("in_range"))


@query()
def folds_of_tasks(spark, sf_dir):
    """Two single labels and both together over five folds, two kinds of models, scaler refitted in each fold."""
    tasks = {"quality": ["quality"], "toxic": ["toxic"], "both": ["quality", "toxic"]}
    return saved_models.folds_of_tasks(_learnable(spark, sf_dir), MODEL_FEATURES, tasks, ["lr", "rf"], "doc_id")


@query("SELECT id, CASE WHEN id % 3 <> 0 THEN 'cat $(find / -name f' || id || ') ~ (uname -a ~ ls ' || event_type ELSE '' END AS inside FROM log")
def nested_commands(spark, sf_dir):
    """The first command in each outermost substitution; one that nothing closes gives none."""
    i = F.col("id").cast("string")
    text = F.concat(F.lit("echo $(cat $(find / -name f"), i, F.lit(") | head) && x=$( (uname -a; id) ) y $(ls "), F.col("event_type"), F.lit(" > /tmp/o) $(open ("))
    rows = event_log(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, text).otherwise("ls (a) $(b").alias("command"))
    return corpus.inner_commands(rows).select("id", F.array_join("inner", " ~ ").alias("inside"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'ac' || id ELSE 'plain ' || event_type END AS t FROM log")
def erased_characters(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("\b\bxy\b\b\bab\bc"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("plain "), F.col("event_type")))
    return rows.select("id", walks.backspaced(text).alias("t"))


_GRAMS = ", ".join(f"({n})" for n in range(1, 5))


@query(PAIRS_SQL + f""", t AS (SELECT conv_id * 1000 + pair AS sample, list_filter(string_split_regex(lower(instruction), '\\s+'), lambda x: x <> '') AS xs, list_filter(string_split_regex(lower(output), '\\s+'), lambda x: x <> '') AS ys FROM pairs),
n AS (SELECT * FROM (VALUES {_GRAMS}) v(n)),
a AS (SELECT sample, n, unnest(list_transform(range(1, greatest(len(xs) - n + 2, 1)), lambda i: array_to_string(xs[i:i + n - 1], ' '))) AS g FROM t, n),
b AS (SELECT sample, n, unnest(list_transform(range(1, greatest(len(ys) - n + 2, 1)), lambda i: array_to_string(ys[i:i + n - 1], ' '))) AS g FROM t, n),
c AS (SELECT sample, n, g, count(*) AS r FROM a GROUP BY ALL), d AS (SELECT sample, n, g, count(*) AS h FROM b GROUP BY ALL),
j AS (SELECT n, sum(least(coalesce(r, 0), coalesce(h, 0))) AS m, sum(coalesce(r, 0)) AS r, sum(coalesce(h, 0)) AS h FROM c FULL JOIN d USING (sample, n, g) GROUP BY n)
SELECT round(CASE WHEN max(h) FILTER (n = 1) > max(r) FILTER (n = 1) THEN 1 ELSE exp(1 - max(r) FILTER (n = 1) / max(h) FILTER (n = 1)) END * CASE WHEN min(m) = 0 THEN 0 ELSE exp(avg(ln(greatest(m, 1) / h))) END, 6) AS bleu FROM j""", log=False)
def corpus_bleu(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("sample", F.col("conv_id") * 1000 + F.col("pair"))
    return evaluation.corpus_bleu(p, "sample", reference="instruction", hypothesis="output").select(_r("bleu", "bleu"))


_KINDS = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(SSH_IDS))


@query(f"SELECT id::VARCHAR AS request_data, CASE id % {len(SSH_IDS)} {_KINDS} END AS event_type FROM log")
def ssh_event_ids(spark, sf_dir):
    """Each event id of the SSH sensor, and one that is none, by its type."""
    ids = F.element_at(F.array(*(F.lit(i) for i, _ in SSH_IDS)), (F.col("id") % len(SSH_IDS) + 1).cast("int"))
    raw = event_log(spark, sf_dir).select(F.to_json(F.struct(ids.alias("eventid"), F.col("id").cast("string").alias("message"))).alias("value"))
    return normalize.normalize_ssh(raw).select("request_data", "event_type")


@query("""SELECT id::VARCHAR AS session_id, 'suricata' AS log_source, 1 AS version, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS time, CASE WHEN id % 6 = 0 THEN 'unknown' ELSE 'flow' END AS event_type, src_ip, CASE WHEN id % 4 = 0 THEN -1 ELSE dest_port END AS src_port,
 dest_ip, 443 AS dest_port, CASE WHEN id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, username, password, CASE WHEN id % 3 = 0 THEN 'printed ' || id WHEN id % 3 = 1 THEN 'raw ' || id END AS request_data, CASE WHEN id % 5 = 0 THEN 'q' || id || '.example' END AS dns_query,
 CASE WHEN id % 7 = 0 THEN 'PUT' WHEN id % 7 = 1 THEN 'GET' END AS http_method, nullif(CASE WHEN id % 2 = 0 THEN 'h.example' ELSE '' END || coalesce(http_uri, ''), '') AS http_uri, CASE WHEN id % 8 = 0 THEN 'UA/8' WHEN id % 8 = 1 THEN 'UA/1' END AS http_user_agent,
 CASE WHEN id % 9 = 0 THEN 'SCAN ' || id END AS alert_type, CASE WHEN id % 9 = 0 THEN severity ELSE -1 END AS severity FROM log""")
def normalize_ids_columns(spark, sf_dir):
    """Every column that the intrusion detector's records give, from all the places that may hold it."""
    i, log, text = F.col("id"), event_log(spark, sf_dir), lambda head: F.concat(F.lit(head), F.col("id").cast("string"))
    some = lambda condition, value, name: F.when(condition, value).alias(name)
    http = F.struct(
        some(i % 7 == 0, F.lit("PUT"), "method"), some(i % 7 == 1, F.lit("GET"), "http_method"), some(i % 4 == 0, F.lit("h.example"), "host"), some(i % 4 == 2, F.lit("h.example"), "hostname"),
        some(i % 3 == 0, F.col("http_uri"), "url"), some(i % 3 != 0, F.col("http_uri"), "uri"), some(i % 8 == 0, F.lit("UA/8"), "user_agent"), some(i % 8 == 1, F.lit("UA/1"), "http_user_agent"),
    )
    fields = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), some(i % 6 != 0, F.lit("flow"), "event_type"), "src_ip", F.when(i % 4 == 0, "none").otherwise(F.col("dest_port").cast("string")).alias("src_port"), "dest_ip",
        F.lit(443).alias("dest_port"), F.when(i % 2 == 0, "TCP").otherwise("UDP").alias("proto"), i.alias("flow_id"), "username", "password", some(i % 3 == 0, text("printed "), "payload_printable"),
        some(i % 3 != 2, text("raw "), "payload"), F.struct(some(i % 5 == 0, F.concat(text("q"), F.lit(".example")), "rrname")).alias("dns"), http.alias("http"), some(i % 9 == 0, F.struct(text("SCAN ").alias("signature"), "severity"), "alert"),
    )
    e = normalize.normalize_ids(log.select(F.to_json(fields).alias("value")))
    columns = ["session_id", "log_source", "version", "event_type", "src_ip", "dest_ip", "dest_port", "protocol", "username", "password", "request_data", "dns_query", "http_method", "http_uri", "http_user_agent", "alert_type"]
    return e.select(*columns, *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("src_port", "severity")), _time("timestamp", "time"))
