"""Conversation structure repair: the cheapest edits of each conversation, by grammar-compressed dynamic programming.

1. Each row becomes one symbol: its role's initial and its fault say all that an edit can cost.
2. Rows are dealt by ranges of (conversation, turn, ...) and cut into segments of a bounded size, so that a conversation of any
   length is many tasks' work. Segments are written, and everything after reads those.
3. Re-Pair rounds: Spark counts adjacent symbols over all segments, the driver takes the most frequent pairs that share no
   symbol as new rules, and the next round counts with those applied. Rules are at most ``rounds * pairs``.
4. One min-plus transfer matrix a rule, from state to state of the wanted pattern, made bottom-up from its two sides: the
   cheapest cost and its audit as a rope of the sides' audits. All segments of all conversations share them.
5. A segment's matrix is the product of its symbols'. From the last segment of a conversation to the first, the best way on
   from each state is chosen; from the first to the last, the way taken is followed and the rows are repaired. Both passes
   hold one segment at a time.

Costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty text 5, and 5 for a truncated row that stays. Blank
and repeated rows must go. The roles left are ``(s?(ua)+)?`` by their initials. Of equal costs the audit that is least in
ASCII is taken. Of two audits from state to state of equal cost none begins with the other (both have one letter for each row
and end with a row's), and an audit determines its way, so comparing audits segment by segment is comparing them whole.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import settled

KEEP, REROLE, DELETE, INSERT, STAY = 0, 1, 2, 5, 5
#: ASCII white space.
BLANKS = " \t\n\x0b\f\r"

# States of the pattern: nothing yet, after s, after u, after a. Empty and after a may end.
START, S, U, A = range(4)
ENDS = (START, A)
NEXT = {START: U, S: U, U: A, A: U}  # where a user or assistant that fits leads
#: Symbols of rows: must go; then initial by initial, whole and truncated.
GONE = 0
INITIALS = "sua"
BASE = 1 + 2 * (len(INITIALS) + 1)

# --- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` of ``conversations``, damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``dropped``, to name its conversation), 1 empties the text, 2 takes out ``. ! ?``, 3 gives
    the row twice, 4 makes the role user. A null counts as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


def with_symbols(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` (blank, duplicate, truncated or null, the first that holds), ``initial`` and ``symbol``; ``nth`` orders rows alike."""
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    blank = F.col("end") == ""
    # Blank rows need no look for their like: their turns spread them.
    alike = W.partitionBy("dropped", "conv_id", "role", F.when(~blank, F.col("text")), F.when(blank, F.col("turn"))).orderBy("turn")
    fault = F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    at = F.instr(F.lit(INITIALS), F.col("initial")).cast("int")
    at = F.when((F.length("initial") == 1) & (at > 0), at - 1).otherwise(len(INITIALS))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + 2 * at + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0)))
    found = rows.withColumn("end", end).withColumn("nth", F.row_number().over(alike)).withColumn("fault", fault)
    return found.withColumn("initial", F.substring("role", 1, 1)).withColumn("symbol", symbol.cast("int")).drop("end")


# --- segments

SEGMENT = "part int, no int, symbols binary, roles array<string>, texts array<string>, initials array<string>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long"
COUNTS = ("blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}


def segments(rows: DataFrame, most_rows: int = 1_024, most_bytes: int = 1 << 18) -> DataFrame:
    """Runs of rows of one conversation in their order, written: at most ``most_rows`` rows, and ``most_bytes`` of text but for one row.

    ``part`` and ``no`` order them. Rows of a turn are ordered by role and text. Rows with ``dropped`` only name their conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0
        made: list[dict] = []

        def close() -> dict:
            nonlocal held, size, no
            live = [r for r in held if not r["dropped"]]
            turns = [r["turn"] for r in live if r["turn"] is not None]
            initials = [r["initial"] for r in live]
            out = {
                "conv_id": held[0]["conv_id"], "part": part, "no": no, "symbols": bytes(r["symbol"] for r in live), "roles": [r["role"] for r in live], "texts": [r["text"] for r in live],
                "initials": [initials[0], initials[-1]] if live else [], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "turns": len(set(turns)),
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, **{c: sum(r["fault"] == c for r in live) for c in COUNTS},
            }
            held, size, no = [], 0, no + 1
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= most_rows or size + len(row["text"]) > most_bytes):
                    made.append(close())
                held.append(row)
                size += len(row["text"])
            if made:
                yield from pa.Table.from_pylist(made, schema).to_batches(max_chunksize=256)
                made = []
        if held:
            yield from pa.Table.from_pylist([close()], schema).to_batches()

    schema = _arrow(rows, SEGMENT)
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text", "nth")
    return settled(ranged.select("conv_id", "turn", "role", "text", "dropped", "fault", "initial", "symbol").mapInArrow(cut, f"conv_id {kind}, {SEGMENT}"), "segments")


def _arrow(rows: DataFrame, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    own = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)])
    return to_arrow_schema(StructType(own.fields + StructType.fromDDL(columns).fields))


# --- grammar

Rules = list[tuple[int, int]]


def replaced(symbols: np.ndarray, rules: Rules) -> np.ndarray:
    """``symbols`` (-1 between sequences) with each rule's pair replaced, rule by rule, from left to right."""
    for k, (a, b) in enumerate(rules):
        hit = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
        if a == b and len(hit):  # of a run every second one
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            first = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
            hit = hit[(hit - first) % 2 == 0]
        if len(hit):
            symbols[hit] = BASE + k
            symbols = np.delete(symbols, hit + 1)
    return symbols


def pair_counts(segs: DataFrame, rules: Rules) -> DataFrame:
    """``a, b, n``: how often symbols stand side by side, once ``rules`` are applied."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BASE + len(rules)
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            joined = replaced(np.frombuffer(b"\xff".join(batch.column("symbols").to_pylist()), np.int8).astype(np.int16), rules)
            a, b = joined[:-1], joined[1:]
            total += np.bincount((a.astype(np.int64) * size + b)[(a >= 0) & (b >= 0)], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(total[at])], ["a", "b", "n"])

    return segs.select("symbols").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def learnt_rules(segs: DataFrame, rounds: int = 6, pairs: int = 6, least: int = 16) -> Rules:
    """Re-Pair: each round takes the most frequent pairs that share no symbol, at most ``pairs``, each seen ``least`` times.

    Which rules there are shapes the work alone, never a result.
    """
    rules: Rules = []
    for _ in range(rounds):
        taken: set[int] = set()
        fresh: Rules = []
        # Distinct pairs are bounded by the square of the symbols.
        for r in pair_counts(segs, rules).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit((BASE + len(rules)) ** 2).collect():
            if len(fresh) < pairs and not taken & {r.a, r.b}:
                fresh.append((r.a, r.b))
                taken |= {r.a, r.b}
        if not fresh:
            break
        rules += fresh
    return rules


# --- min-plus matrices

#: From state to state: the cheapest cost with its audit, an audit being a string or two ropes.
Way = tuple[int, "str | tuple"]
Matrix = list[list[Way | None]]


def flat(rope: str | tuple) -> str:
    out, stack = [], [rope]
    while stack:
        if isinstance(x := stack.pop(), str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def better(a: Way | None, b: Way | None) -> Way | None:
    if a is None or b is None or a[0] != b[0]:
        return min((x for x in (a, b) if x is not None), key=lambda x: x[0], default=None)
    return a if flat(a[1]) <= flat(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for m in range(4):
            if (a := x[p][m]) is not None:
                for q in range(4):
                    if (b := y[m][q]) is not None:
                        out[p][q] = better(out[p][q], (a[0] + b[0], (a[1], b[1])))
    return out


def unit() -> Matrix:
    return [[(0, "") if p == q else None for q in range(4)] for p in range(4)]


def inserts() -> Matrix:
    """No insertion, one or two: after two the state has come round."""
    out = unit()
    for p in range(4):
        one = NEXT[p]
        out[p][one] = better(out[p][one], (INSERT, "I"))
        out[p][NEXT[one]] = better(out[p][NEXT[one]], (2 * INSERT, "II"))
    return out


def of_row(symbol: int) -> Matrix:
    """Insertions before the row, then what becomes of it."""
    row: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        row[p][p] = (DELETE, "D")
        if symbol == GONE:
            continue
        initial, more = (*INITIALS, "")[(symbol - 1) // 2], STAY * ((symbol - 1) % 2)
        to = NEXT[p]
        row[p][to] = better(row[p][to], (REROLE + more, "R"))
        if initial == "s" and p == START:
            row[p][S] = (KEEP + more, "K")
        elif initial == {U: "u", A: "a"}[to]:
            row[p][to] = better(row[p][to], (KEEP + more, "K"))
    return product(inserts(), row)


def rule_matrices(rules: Rules) -> list[Matrix]:
    """A matrix for each symbol, rows first and then rule by rule from the matrices of its sides."""
    made = [of_row(k) for k in range(BASE)]
    for a, b in rules:
        made.append(product(made[a], made[b]))
    return made


def whole(symbols: list[int], matrices: list[Matrix]) -> Matrix:
    """The product in order, by halves, so that ropes are compared over few letters."""
    if not symbols:
        return unit()
    parts = [matrices[s] for s in symbols]
    while len(parts) > 1:
        parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


class Products:
    """Matrices of symbol sequences with flat audits; the last ``most`` different short ones are remembered."""

    def __init__(self, rules: Rules, most: int = 20_000):
        self.rules, self.matrices, self.most = rules, rule_matrices(rules), most
        self.known: OrderedDict[bytes, Matrix] = OrderedDict()

    def of(self, symbols: bytes) -> Matrix:
        if (found := self.known.get(symbols)) is not None:
            self.known.move_to_end(symbols)
            return found
        made = whole(replaced(np.frombuffer(symbols, np.int8).astype(np.int16), self.rules).tolist(), self.matrices)
        made = [[None if w is None else (w[0], flat(w[1])) for w in line] for line in made]
        if len(symbols) <= 64:
            self.known[symbols] = made
            if len(self.known) > self.most:
                self.known.popitem(last=False)
        return made


@cache
def endings() -> tuple[Way | None, ...]:
    """What it takes to end from each state: nothing, or insertions."""
    last = inserts()
    return tuple(min((last[p][q] for q in ENDS if last[p][q] is not None), default=None) for p in range(4))


# --- the two passes

WAYS = "costs array<long>, audits array<string>, next array<int>, ending array<string>"
REPAIRED = "part int, no int, audit string, repaired array<struct<role: string, text: string>>, cost long, blank long, duplicate long, truncated long, illegal long, gaps long, last boolean"


def _streamed(segs: DataFrame, backwards: bool) -> DataFrame:
    """Each conversation's segments together in one partition and in order, to be read one by one."""
    order = [F.desc("part"), F.desc("no")] if backwards else ["part", "no"]
    return segs.repartition("conv_id").sortWithinPartitions(F.col("conv_id").isNull(), "conv_id", *order)


def chosen_ways(segs: DataFrame, rules: Rules) -> DataFrame:
    """``segs`` with, for each state before the segment, the cheapest cost from there to the conversation's end, the audit in
    the segment, the state after it, and what is inserted after the last segment."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, now, onward = Products(rules), object(), []
        for batch in batches:
            out = []
            for conv, symbols in zip(batch.column("conv_id").to_pylist(), batch.column("symbols").to_pylist()):
                ending = None
                if conv != now:
                    now, onward = conv, [w[0] for w in endings()]
                    ending = [w[1] for w in endings()]
                matrix, costs, audits, after = products.of(symbols), [], [], []
                for p in range(4):
                    cost, audit, q = min((w[0] + onward[q], w[1], q) for q, w in enumerate(matrix[p]) if w is not None)
                    costs.append(cost)
                    audits.append(audit)
                    after.append(q)
                onward = costs
                out.append((costs, audits, after, ending))
            columns = [pa.array(x, f.type) for x, f in zip(zip(*out), more)] if out else [pa.array([], f.type) for f in more]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in more)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    more = list(to_arrow_schema(StructType.fromDDL(WAYS)))
    kind = segs.schema["conv_id"].dataType.simpleString()
    return _streamed(segs, True).mapInArrow(choose, f"conv_id {kind}, {SEGMENT}, {WAYS}")


def _edited(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[dict], int]:
    """The rows that ``audit`` leaves, and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        keeps_s = edit == "K" and roles[at][:1] == "s"
        state = S if keeps_s else NEXT[state]
        name = {U: "user", A: "assistant"}.get(state)
        out.append({"role": name, "text": ""} if edit == "I" else {"role": roles[at] if edit == "K" else name, "text": texts[at]})
        at += edit != "I"
    return out, state


def repaired(rows: DataFrame, rounds: int = 6, pairs: int = 6) -> DataFrame:
    """The repaired rows of each conversation of ``rows`` (``conv_id, turn, role, text, dropped``), segment by segment.

    ``repaired`` has the rows that stay, ``audit`` the edits, ``cost`` the whole conversation's (in its first segment; 0 in
    others); faults, wrong neighbours and missing turns are counted in the segment, with what lies between it and the one
    before. Segments of a conversation are in one partition in the order of ``part, no``.

    A conversation without rows has one segment without edits. Null ``conv_id`` is one conversation; a null turn comes first
    and counts as no turn. Role and text may not be null (``damaged`` makes them a space). Extra columns are left out.
    """
    segs = segments(with_symbols(rows.select("conv_id", "turn", "role", "text", "dropped")))
    rules = learnt_rules(segs, rounds, pairs)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, initial, turn = object(), START, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first = r["conv_id"] != now
                if first:
                    now, state, initial, turn = r["conv_id"], START, None, None
                audit, cost = r["audits"][state], r["costs"][state] if first else 0
                rows, after = _edited(audit, r["roles"], r["texts"], state)
                state = r["next"][state]
                assert after == state, "an audit leads where its way leads"
                if r["ending"] is not None:
                    more, _ = _edited(r["ending"][state], [], [], state)
                    rows, audit = rows + more, audit + r["ending"][state]
                gaps, illegal = 0, r["illegal"]
                if r["first_turn"] is not None:
                    # The span of turns less their number; a turn that goes on in this segment counts once.
                    gaps = r["last_turn"] - r["first_turn"] + 1 - r["turns"]
                    if turn is not None:
                        gaps += max(0, r["first_turn"] - turn - 1)
                    turn = r["last_turn"]
                if r["initials"]:
                    illegal += initial is not None and initial + r["initials"][0] not in LEGAL
                    initial = r["initials"][1]
                out.append({"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "audit": audit, "repaired": rows, "cost": cost, "illegal": illegal, "gaps": gaps, "last": r["ending"] is not None, **{c: r[c] for c in COUNTS}})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    schema, kind = _arrow(rows, REPAIRED), rows.schema["conv_id"].dataType.simpleString()
    return _streamed(chosen_ways(segs, rules), False).mapInArrow(follow, f"conv_id {kind}, {REPAIRED}")


def repaired_rows(segs: DataFrame) -> DataFrame:
    """``conv_id, part, no, place, role, text`` of what ``repaired`` gives, a row for each row that stays or is inserted."""
    return segs.select("conv_id", "part", "no", F.posexplode("repaired").alias("place", "row")).select("conv_id", "part", "no", "place", "row.role", "row.text")


def digests(segs: DataFrame) -> DataFrame:
    """One row for each conversation of what ``repaired`` gives: its counts, cost and audit, and the SHA-256 of its rows as
    ``role:text``, one to a line. The hash is taken row by row; what grows with a conversation is its audit alone."""
    totals = ("gaps", *COUNTS, "illegal", "cost")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, audits, sha, lines = dict.fromkeys(totals, 0), [], hashlib.sha256(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for c in totals:
                    sums[c] += r[c]
                audits.append(r["audit"])
                for row in r["repaired"]:
                    sha.update(("\n" * (lines > 0) + f"{row['role']}:{row['text']}").encode())
                    lines += 1
                if r["last"]:
                    out.append({"conv_id": r["conv_id"], **sums, "audit": "".join(audits), "repaired_sha256": sha.hexdigest()})
                    sums, audits, sha, lines = dict.fromkeys(totals, 0), [], hashlib.sha256(), 0
            yield from pa.Table.from_pylist(out, schema).to_batches()

    columns = ", ".join(f"{c} long" for c in totals) + ", audit string, repaired_sha256 string"
    schema, kind = _arrow(segs, columns), segs.schema["conv_id"].dataType.simpleString()
    return segs.mapInArrow(digest, f"conv_id {kind}, {columns}")


def repair_report(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """The digest of each original conversation after ``damage`` and repair. An empty table gives no rows."""
    return digests(repaired(damage(conversations)))


def _oracle() -> str:
    """The same by plain dynamic programming from the last row to the first: a way is its cost in eight digits and its audit."""
    more = lambda way, cost, edits: f"lpad((left({way}, 8)::INT + {cost})::VARCHAR, 8, '0') || '{edits}' || substr({way}, 9)"
    stays = {0: ("w2", "u"), 1: ("w2", "u"), 2: ("w3", "a"), 3: ("w2", "u")}
    here = []
    for p, (to, initial) in stays.items():
        ways = [more(f"w{p}", 2, "D"), f"CASE WHEN NOT gone THEN {more(to, '1 + more', 'R')} END", f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more(to, 'more', 'K')} END"]
        if p == 0:
            ways.append(f"CASE WHEN NOT gone AND initial = 's' THEN {more('w1', 'more', 'K')} END")
        here.append(f"least({', '.join(ways)}) AS b{p}")
    then = [f"least(b{p}, {more(f'b{one}', 5, 'I')}, {more(f'b{two}', 10, 'II')}) AS w{p}" for p, one, two in ((0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3))]
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::UBIGINT)),
    lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c & 255::UBIGINT, b), list_transform(range(8), lambda i: i::UBIGINT)),
      lambda x, i: CASE WHEN x & 1::UBIGINT = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))) % 20 AS kind FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM coded WHERE kind = 3
), placed AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ends,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), alike AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed
), marked AS (
  SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM alike
), symbols AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM marked
), ways AS (
  SELECT conv_id, max(i) + 1 AS i, '00000000' AS w0, '00000010II' AS w1, '00000005I' AS w2, '00000000' AS w3 FROM symbols GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {', '.join(then)} FROM (
    SELECT s.conv_id, s.i, {', '.join(here)} FROM ways w JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i - 1)
), best AS (
  SELECT conv_id, left(w0, 8)::BIGINT AS cost, substr(w0, 9) AS audit FROM ways WHERE i = 1
), edits AS (
  SELECT conv_id, edit, j, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS e
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS j FROM best)
), stay AS (
  SELECT d.conv_id, d.edit, d.j, d.e, s.role, CASE WHEN d.edit = 'I' THEN '' ELSE s.text END AS text, max(CASE WHEN d.edit = 'K' AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS led
  FROM edits d LEFT JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.i = d.i WHERE d.edit <> 'D'
), mended AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS lines FROM stay GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal FROM symbols GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = _oracle()
