"""Instruction and answer pairs: from terminals, logins, downloads and chained commands, merged without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.walks import substitutions
from . import ranks


def turn_pairs(turns: DataFrame, key: str, order: str, side: str, text: str, asks: str, answers: str, clean: bool = False) -> DataFrame:
    """``key, pair, instruction, output``: each run of ``asks`` turns joined, with the ``answers`` run after it.

    Answers before the first question, and pairs with an empty side, are left out.
    """
    w = W.partitionBy(key).orderBy(order)
    rows = turns.where(F.col(side).isin(asks, answers))
    opens = (F.col(side) == asks) & F.coalesce(F.lag(side).over(w) != asks, F.lit(True))
    numbered = rows.withColumn("_opens", opens.cast("int")).withColumn("pair", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).where("pair > 0")
    joined = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(side) == who, F.struct(order, text)))), lambda x: x[text]), "")
    pairs = numbered.groupBy(key, "pair").agg(joined(asks).alias("instruction"), joined(answers).alias("output"))
    if clean:
        pairs = pairs.withColumns({"instruction": T.clean_input(F.col("instruction")), "output": T.clean_output(F.col("output"))})
    return pairs.where("instruction <> '' and output <> ''")


def without_repeats(sources: list[DataFrame], order: str = "ord") -> DataFrame:
    """``instruction, output, source_rank``: sources one after the other, the first of equal trimmed instructions kept."""
    out = None
    for rank, source in enumerate(sources):
        ranked = source.select("instruction", "output", F.col(order).alias("ord")).withColumn("source_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    first = F.min_by(F.struct("instruction", "output", "source_rank"), F.struct("source_rank", "ord")).alias("row")
    return out.groupBy(F.trim("instruction").alias("_key")).agg(first).select("row.*")


def chained(commands: DataFrame, column: str = "command") -> DataFrame:
    """Rows of ``commands`` exploded to their parts: ``part`` (place), ``sub_command`` without pipes and redirections, ``base_cmd``."""
    parts = commands.select("*", F.posexplode(F.split(F.trim(column), r"\s*(?:&&|;)\s*")).alias("part", "_sub"))
    return parts.withColumn("sub_command", head_of(F.col("_sub"))).drop("_sub").where("sub_command <> ''").withColumn("base_cmd", base_command(F.col("sub_command")))


def head_of(sub: Column) -> Column:
    """A command before its first pipe, without redirections."""
    head = F.trim(F.get(F.split(sub, r"[|]"), 0))
    for pattern in (r"\s*\d*>>?\s*&?\S+", r"\s*<\s*\S+", r"\s*2>&1"):
        head = F.regexp_replace(head, pattern, "")
    return F.trim(head)


def base_command(command: Column) -> Column:
    """The name of the program: the last part of the first word's path."""
    return F.regexp_extract(F.regexp_extract(command, r"^\S+", 0), r"[^/]*$", 0)


def inner_commands(commands: DataFrame, column: str = "command") -> DataFrame:
    """Commands with ``inner``: the first command in each ``$( )``, parentheses inside counted."""

    first = lambda x: head_of(F.get(F.split(F.trim(x), r"\s*(?:&&|;)\s*"), 0))
    return commands.withColumn("inner", F.filter(F.transform(substitutions(F.col(column)), first), lambda x: x != ""))


def with_response(commands: DataFrame, responses: DataFrame) -> DataFrame:
    """``response`` of ``base_cmd``, or what a shell says of a command it doesn't know."""
    known = responses.groupBy("base_cmd").agg(F.max("response").alias("_known"))
    unknown = F.concat(F.lit("-bash: "), F.col("base_cmd"), F.lit(": command not found"))
    return commands.join(known, "base_cmd", "left").withColumn("response", F.coalesce("_known", unknown)).drop("_known")


def login_pairs(events: DataFrame, column: str = "raw") -> DataFrame:
    """Different ``username, password`` of messages with ``[user/password]``."""
    pattern = r"\[([^/]+)/([^\]]+)\]"
    found = events.where(F.col(column).rlike(pattern)).select(F.trim(F.regexp_extract(column, pattern, 1)).alias("username"), F.trim(F.regexp_extract(column, pattern, 2)).alias("password"))
    return found.distinct()


def download_pairs(events: DataFrame, column: str = "raw", order: str = "ord") -> DataFrame:
    """Different urls of JSON records, with host and file name, the first record of each; ``form`` alternates in order."""
    value = lambda k: F.try_variant_get(F.try_parse_json(column), f"$.{k}", "string")
    rows = events.select(order, value("url").alias("url"), value("destfile").alias("destfile"), value("shasum").alias("shasum")).where("url <> ''")
    first = rows.groupBy("url").agg(F.min_by(F.struct(order, "destfile", "shasum"), order).alias("r")).select("url", "r.*")
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.coalesce(F.nullif(F.element_at(F.split("destfile", "/"), -1), F.lit("")), F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("index.html"))
    form = F.when(F.col("_place") % 2 == 1, "wget").otherwise("curl")
    first = ranks.running(first, [], ranks.by_size(first, order), [F.col(order), F.col("url")], {"_place": None})
    return first.select(order, "url", F.try_parse_url("url", F.lit("HOST")).alias("host"), name.alias("file_name"), "shasum", form.alias("form"))


def sizes(sources: dict[str, DataFrame]) -> DataFrame:
    """``name, parsed, skipped, different`` of each source of ``instruction, output``: rows, rows with an empty side, and different trimmed instructions of the rest."""
    out = None
    for name, rows in sources.items():
        part = rows.select(F.lit(name).alias("name"), F.trim("instruction").alias("i"), (F.coalesce("output", F.lit("")) == "").alias("bare"))
        out = part if out is None else out.unionByName(part)
    skipped = (F.coalesce("i", F.lit("")) == "") | F.col("bare")
    return out.groupBy("name").agg(F.count("*").alias("parsed"), F.count_if(skipped).alias("skipped"), F.countDistinct(F.when(~skipped, F.col("i"))).alias("different"))


def masked_text(pairs: DataFrame) -> DataFrame:
    """One text of a pair for masked training; pairs with both sides empty are left out."""
    full = F.concat(F.coalesce("instruction", F.lit("")), F.lit(" [SEP] "), F.coalesce("output", F.lit("")))
    return pairs.where("coalesce(instruction, '') <> '' or coalesce(output, '') <> ''").select(full.alias("text"))
