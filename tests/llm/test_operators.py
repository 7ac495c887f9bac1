"""Each operator on odd rows, against plain versions: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import same  # noqa: E402

from sensorlens.llm import common, html_text, language_id, media, mixing, packing, quality_rules, queries, simhash, token_counts, token_store, warc, word_ids  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, fp string, size string, _row string, host string, place string, token string"


def odd_rows():
    long = " ".join(f"word{k % 700} of" for k in range(20_000))
    texts = [
        None, "", " \t\n ", "One", "two words", "<|endoftext|> inside <|startoftext|>.", "Émile, l'été! ça va? İstanbul ΣΑΣ.", "a b c a b c\na b c\na b c\nx", long, "no letters: 123 456 !!",
        "the cat sat on the mat and the dog sat on the log " * 8, "THE CAT sat on the mat and the dog sat on the log " * 8, "x" * 5000, "tab\tand\x0bvertical\x1cfile \U0001f600 emoji", "$$$ ### %%% junk *** &&& " * 20,
        "पहाड़, है। বিষয়, আমি שלוםבּ! གྷ. J̌ Ḧ, É À×Ÿ don't l'été x́.",
    ]
    rows = [(k, t, None if k == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None, "r", "f", "z", "w", "h", "p", "t") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a text without id", "en", "s0", 1, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship_package(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return common.table(spark, data, "documents")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(odd, none, docs, library):
    path, tok = queries.tokenizer_path("byte_bpe_50k.json"), library["byte_bpe_50k"]
    for df, head in ((odd, 5), (docs, 50)):
        want = []
        for r in df.select("doc_id", "text").collect():
            n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
        assert rows(token_counts.token_counts(df, path, head_size=head)) == sorted(want, key=repr)
    assert rows(token_counts.token_counts(none, path)) == []


def test_pretokens_agree_with_the_library_on_any_text(library):
    import random

    path, tok, draw = queries.tokenizer_path("byte_bpe_50k.json"), library["byte_bpe_50k"], random.Random(5)
    split = token_counts.pre_tokenizer(path)
    for _ in range(3000):
        text = "".join(draw.choice("aB1 .'st\n\t\x1c é́<|>endoftxİ 日") for _ in range(draw.randrange(30)))
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in split(text)) == len(tok.encode(text, add_special_tokens=False).ids)


def test_word_ids_agree_with_the_library_on_any_text(library):
    import random
    import unicodedata

    import pyarrow as pa

    path, draw = queries.tokenizer_path("word_bpe_49k.json"), random.Random(6)
    texts = ["".join(draw.choice("aA.,!?'sS tT1-&é́̌ͅéÉÀ×÷ÿİΣß1<|>\n\t\x1c\xa0endoftext가각ㄱḦब़ּकबাড়གྷ") for _ in range(draw.randrange(40))) for _ in range(5000)]
    texts += ["<|endoftext|>.", "<|STARTOFTEXT|>", "É <|endoftext|> J̌ x.", "é. x", "", None]
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    taken_apart = [c for c in points if unicodedata.normalize("NFC", c) != c or unicodedata.decomposition(c)]
    texts += [f"a{c}." for c in points] + [f"{a}{c}{m}" for c in taken_apart for a in ("", "A") for m in ".,!?'"]
    texts += [f"{chr(a)}{chr(c)}." for a in [*range(65, 91), *range(97, 123)] for c in range(0x300, 0x370)]
    want = [x.ids for x in library["word_bpe_49k"].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for encoder, step in ((word_ids.WordEncoder(path), 50_000), (word_ids.WordEncoder(path, remembered=300), 10_000)):  # with words forgotten
        for at in range(0, len(texts), step):
            ids, before = encoder.encode(pa.array(texts[at : at + step], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == want[at : at + step]
    ids, before = encoder.encode(pa.array(texts[:9], pa.string()).slice(3, 4))
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == want[3:7]


def _ids(tok, text, end):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_store(spark, odd, none, docs, library):
    path, tok = queries.tokenizer_path("word_bpe_49k.json"), library["word_bpe_49k"]
    for df in (odd, docs):
        folder = common.new_folder(spark, "store")
        got = token_store.stored_digests(df, path, folder).collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0, len(i), zlib.crc32(i.tobytes())) for r in df.collect() for i in [_ids(tok, r.text, 2)]), key=lambda x: x[:2])
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
        start = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == start
            start += r.n_tokens
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
        assert ids == sorted(ids)
        whole = {(r.doc_id, r.start): zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes()) for r in token_store.read_ids(spark, folder).collect()}
        assert whole == {(r.doc_id, r.start): r.ids_crc32 for r in got}
    assert rows(token_store.stored_digests(none, path, common.new_folder(spark, "store"))) == []


def test_token_store_keeps_shared_passages_once_and_sees_damage(spark):
    path, folder = queries.tokenizer_path("word_bpe_49k.json"), common.new_folder(spark, "store")
    passage = " ".join(f"item{k} value{k * 7}" for k in range(4000))
    df = spark.createDataFrame([(k, f"start {k} " + passage) for k in range(6)], "doc_id long, text string")
    token_store.write_store(df, path, folder)
    chunks = spark.read.parquet(f"{folder}/parts").where("kind = 'chunk'")
    recipes = spark.read.parquet(f"{folder}/recipes").selectExpr("sum(size(addresses)) AS n").first().n
    assert chunks.count() == chunks.select("key").distinct().count() < recipes / 3
    token_store.verify_manifest(spark, folder)
    bad = common.new_folder(spark, "store")
    chunks.unionByName(spark.read.parquet(f"{folder}/parts").where("kind = 'recipe'")).selectExpr("kind", "key", "CASE WHEN kind = 'chunk' THEN reverse(body) END AS body", "row_id", "doc_id", "addresses", "lengths").write.partitionBy("kind").parquet(f"{bad}/parts")
    spark.read.parquet(f"{folder}/recipes").write.parquet(f"{bad}/recipes")
    with pytest.raises(Exception, match="other bytes than its address"):
        token_store.read_digests(spark, bad).collect()


def test_crc32_of_parts():
    parts = [b"abc", b"", b"x" * 1000, b"12"]
    assert token_store.joined_crc32([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def _packed_right(got, wanted):
    """``wanted``: ids of each row. Gives the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, lists in wanted.items():
        left = Counter((len(i), zlib.crc32(i.tobytes())) for i in lists)
        assert sum(r.length for r in pieces[doc]) == sum(map(len, lists))
        if len(lists) == 1:
            at, ids = 0, lists[0]
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
                at += r.length
        else:
            assert all(r.doc_tokens in {n for n, _ in left} for r in pieces[doc])
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(r.length for r in got))


def test_packing(odd, none, docs, library):
    path, tok = queries.tokenizer_path("word_bpe_49k.json"), library["word_bpe_49k"]
    for df, most in ((odd, 0.02), (docs, 0.02)):
        wanted = defaultdict(list)
        for r in df.collect():
            wanted[r.doc_id].append(_ids(tok, r.text, 1))
        assert _packed_right(packing.packed(df, path, block=1 << 14).collect(), wanted) <= most
    assert rows(packing.packed(none, path)) == []


def test_cuts_are_the_best_ones():
    import random

    draw = random.Random(3)
    for _ in range(40):
        places, kinds = [0], [0]
        while len(places) < 14:
            places.append(places[-1] + draw.randrange(1, 9))
            kinds.append(draw.randrange(3))
        width, penalty = 16, (1, 3, 7)

        def pad(n, width=width):
            return 0 if n & (n - 1) == 0 else width - n

        best = [0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min((best[i] + pad(places[j] - places[i]) + penalty[kinds[j]] for i in range(j) if places[j] - places[i] <= width), default=math.inf)
        cuts = packing.best_cuts(places, kinds, width, penalty)
        assert sum(pad(places[b] - places[a]) + penalty[kinds[b]] for a, b in zip(cuts, cuts[1:])) == best[-1]


def _counted(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if seen[(w[k], w[k + 1], w[k + 2])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none, docs, data):
    labels = common.table(spark, data, "labels")
    for df in (odd, docs):
        got = quality_rules.judged(df, labels).collect()
        texts = Counter((r.doc_id, *_counted(r.text)) for r in df.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.rule is None)
    assert rows(quality_rules.judged(none, labels)) == []
    assert rows(quality_rules.judged(none, labels.limit(0))) == []


def test_learnt_rules_part_good_from_bad(spark):
    good = [(k, f"Plain sentence number {k} with quite ordinary words in it. " * (6 + k % 5) + f"end{k}", 1) for k in range(150)]
    bad = [(1000 + k, " ".join(f"w{k}x{j} |" for j in range(60)), 0) for k in range(60)]
    df = spark.createDataFrame([(k, t) for k, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in good[::2] + bad[::2]] + [(None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(quality_rules.text_statistics(df, ["doc_id"]), labels)
    assert rules and all(c.feature in quality_rules.FEATURES for r in rules for c in r)
    verdicts = quality_rules.text_statistics(df, ["doc_id"]).select("doc_id", quality_rules.verdict(rules).alias("v")).collect()
    assert all((r.v is None) == (r.doc_id < 1000) for r in verdicts)


def test_keep_good_keeps_the_rows_judged_good(spark, odd, docs, data):
    labels = common.table(spark, data, "labels")
    for df in (odd, docs):
        want = Counter(r.doc_id for r in quality_rules.judged(df, labels).where("kept").collect())
        kept = quality_rules.keep_good(df, labels)
        assert kept.schema == df.schema and Counter(r.doc_id for r in kept.collect()) == want


def test_language_id(spark, odd, none, data):
    df = common.table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = language_id.identified(df).collect()
    assert {r.doc_id for r in got} == set(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    blind = language_id.fit(df.withColumn("lang", language_id.F.when(language_id.held_out(), "zz").otherwise(language_id.F.col("lang"))))
    assert "zz" not in blind.languages
    odds = language_id.identified(odd).collect()
    assert len(odds) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in odds:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert rows(language_id.identified(none)) == []
    kept = language_id.keep_identified(odd)
    assert kept.schema == odd.schema and kept.count() == sum(not r.rejected for r in odds)


def _fingerprint(text):
    import xxhash

    low = (text or "").translate({65 + k: 97 + k for k in range(26)})
    w = WORD.findall(low)
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, bits=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(odd, none, docs):
    for df in (odd, docs):
        source = df.select("doc_id", "text").collect()
        fps = [_fingerprint(r.text) for r in source]
        groups = defaultdict(set)
        for r, c in zip(source, _components(fps), strict=True):
            groups[c].add(r.doc_id)
        least = {c: min((d for d in ids if d is not None), default=None) for c, ids in groups.items()}
        want = Counter((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(source, fps, _components(fps), strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert rows(simhash.near_duplicates(none)) == []


def _crowd(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 3, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2, n // 3)).astype(np.uint64)
    tight = rng.integers(0, 1 << 9, n // 3, np.uint64)  # many values within a few bits
    return np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1] ^ np.uint64(4), tight]))


def test_tree_loses_no_link(spark):
    fps = _crowd(1500)
    want = {int(f): int(fps[c]) for f, c in zip(fps, _components([int(x) for x in fps]), strict=True)}
    groups = spark.createDataFrame([(int(np.int64(f)),) for f in fps.view(np.int64)], "fp long").repartition(4)
    for options in ({"shard_size": 64, "sample_size": 500}, {"shard_size": 64, "dense": 100}, {"shard_size": 5000}, {"shard_size": 5000, "dense": 120, "leaves": 40}, {"shard_size": 400, "dense": 30, "leaves": 3, "sample_size": 800}):
        got = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(groups, **options)).collect()}
        parts = defaultdict(set)
        for f in fps.tolist():
            signed = int(np.uint64(f).view(np.int64))
            parts[got.get(signed, signed)].add(f)
        parted = defaultdict(set)
        for f, c in want.items():
            parted[c].add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, parted.values()))


def test_keep_one_of_each(odd):
    kept = simhash.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    found = simhash.near_duplicates(odd.where("doc_id is not null")).collect()
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({r.component_id for r in found})
    assert kept.where("doc_id is null").count() == 2


def test_mixing(spark, odd, none, docs, duck):
    same(mixing.mixed(docs).toPandas(), duck.sql(mixing.ORACLE_SQL).df())
    got = mixing.mixed(odd).collect()
    sizes = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    by = defaultdict(lambda: [0, 0])
    names = [(r.source, len(WORD.findall(r.text or ""))) for r in odd.collect()]
    for s, n in names:
        by[s][0] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target, open_, rest = {}, set(order), sum(v[0] for v in by.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    while True:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * by[s][0]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * by[s][0] for s in over}
        rest -= sum(3 * by[s][0] for s in over)
        open_ -= over
    sizes_of = {by[s][0]: target[s] for s in order}
    assert all(r.target == pytest.approx(sizes_of[r.source_size]) for r in got)
    assert rows(mixing.mixed(none)) == []
    again = mixing.mixed(docs.repartition(5))
    assert rows(again) == rows(mixing.mixed(docs))
    emitted = mixing.emit_mix(docs)
    copies = {r.doc_id: r.taken // r.size for r in again.collect() if r.size}
    assert emitted.schema == docs.schema
    assert Counter(r.doc_id for r in emitted.collect() if r.doc_id in copies) == Counter({d: n for d, n in copies.items() if n})
    assert mixing.emit_mix(odd).schema == odd.schema


PAGES = "page_id long, url string, html string, row_id string, host string, template string"


def odd_pages():
    return [
        (1, "http://a.example/x", "<html><body><nav>menu</nav><article><h1>Title &amp; more</h1><p>One <b>bold</b>\n text<p>Two<br>three</article><footer>f</footer>", "", "", ""),
        (2, None, None, "", "", ""), (3, "", "", "", "", ""), (None, "http://a.example/y", "plain text only", "", "", ""), (1, "http://a.example/x", "<p>repeated</p>", "", "", ""),
        (4, "http://b.example/?q=1\r\nx", "<script>var a='<p>no</p>';</script><p>yes &lt;p&gt; &#233;</p><!-- <p>c</p> --><style>p{}</style><div class='sidebar'>s</div><form>f</form>", "", "", ""),
        (5, "http://b.example/2", "<main><header><h2>Kept</h2></header><aside>no</aside><p>body\r\n\r\n text</p><div id='comments'><p>no</p></div></main><p>outside</p>", "", "", ""),
    ]


def test_html_text(spark, data):
    common.ship_package(spark)
    got = html_text.main_texts(spark.createDataFrame(odd_pages(), PAGES)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter(
        [(1, "Title & more\nOne bold text\nTwo\nthree"), (2, ""), (3, ""), (None, "plain text only"), (1, "repeated"), (4, "yes <p> é"), (5, "Kept\nbody text")]
    )
    assert all(r.n_chars == len(r.text) for r in got)
    assert rows(html_text.main_texts(spark.createDataFrame([], PAGES))) == []
    import html

    pages = common.table(spark, data, "pages")
    for r, p in zip(sorted(html_text.main_texts(pages).collect(), key=lambda r: r.page_id), sorted(pages.collect(), key=lambda p: p.page_id), strict=True):
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_names_and_unseen_parts():
    page = html_text.Page("<div class='page-header'>no</div><article><div class='entry-header'><h1>Kept</h1></div><p hidden>no</p><p style='display: none'>no</p><p data-x='hidden'>yes</p><div class='cookie-notice'>no</div></article>")
    assert page.main_text(frozenset()) == "Kept\nyes"


def test_template_text_is_left_out(spark):
    rows_ = [(k, f"http://t.example/{k}", f"<div><p>Welcome to our pages</p><p>Story {k} is about number {k * k}.</p><p>All about us</p></div>") for k in range(30)]
    got = html_text.main_texts(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} is about number {r.page_id ** 2}." for r in got)


def test_warc(spark, duck, data):
    got = queries.op8_warc(spark, data).toPandas()
    same(got, duck.sql(warc.ORACLE_SQL).df())
    assert 0 < got["damaged"].sum() < len(got)
    got = warc.audited_pages(spark.createDataFrame(odd_pages(), PAGES)).collect()
    want = Counter((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), False) for p, _, h, *_ in odd_pages())
    assert Counter(map(tuple, got)) == want
    assert rows(warc.audited_pages(spark.createDataFrame([], PAGES))) == []


def test_audit_finds_the_damaged_records(spark, data):
    a, b = common.new_folder(spark, "a"), common.new_folder(spark, "b")
    warc.write_warc(common.table(spark, data, "pages").repartition(3), a, archive_bytes=8_000)
    warc.replicate(spark, a, b)
    index = warc.index(spark, b).toPandas().sort_values(["archive", "ordinal"]).reset_index(drop=True)
    assert index["archive"].nunique() > 3
    hit = index.iloc[[0, 17, 18, len(index) - 1]]
    for r in hit.itertuples():
        path = b.removeprefix("file://") + "/" + r.archive
        raw = bytearray(Path(path).read_bytes())
        raw[r.offset + r.size // 2] ^= 1
        Path(path).write_bytes(raw)
    gone = index["archive"].unique()[2]
    Path(b.removeprefix("file://") + "/" + gone).unlink()
    levels = warc.write_tree(spark, a)
    assert warc.write_tree(spark, b) == levels
    found = {(r.archive, r.ordinal) for r in warc.audit(spark, a, b, levels).collect()}
    assert found == set(zip(hit["archive"], hit["ordinal"])) | {(gone, o) for o in index[index["archive"] == gone]["ordinal"]}
    whole = Counter((r.page_id, hashlib.sha256((r.html or "").encode()).hexdigest()) for r in common.table(spark, data, "pages").collect())
    differing = warc.audit(spark, a, b, levels)
    for one, other in ((a, b), (b, a)):  # whichever is damaged, the other one heals
        got = warc.healed(spark, one, other, differing).collect()
        assert Counter((r.page_id, r.payload_sha256) for r in got) == whole
        assert sum(r.damaged for r in got) == len(found)
    both = index.iloc[17]
    path = a.removeprefix("file://") + "/" + both.archive
    raw = bytearray(Path(path).read_bytes())
    raw[both.offset + both["size"] // 2] ^= 1
    Path(path).write_bytes(raw)
    lost = [r for r in warc.healed(spark, a, b, differing).collect() if r.payload_sha256 is None]
    assert len(lost) == 1 and lost[0].damaged


def test_archives_are_dealt_over_tasks(spark, data):
    folder = common.new_folder(spark, "a")
    warc.write_warc(common.table(spark, data, "pages").repartition(2), folder, archive_bytes=8_000)
    tasks = warc.members(spark, folder).select(warc.F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3


def test_media(spark, odd, none, docs):
    for df in (odd, docs):
        got = media.stored_media(df, common.new_folder(spark, "media"), archive_bytes=20_000).collect()
        want = Counter()
        for r in df.collect():
            raw = (r.text or "").encode()
            full = raw + b" " * (-len(raw) % 192) or b" " * 192
            want[(r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        stored = defaultdict(set)
        for r in got:
            stored[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
        assert all(len(v) == 1 for v in stored.values())
    assert rows(media.stored_media(none, common.new_folder(spark, "media"))) == []


def test_media_members_fail_alone(spark, docs):
    folder = common.new_folder(spark, "media")
    media.write_media(docs.coalesce(1), folder)
    whole = media.read_media(spark, folder, range_bytes=4096).orderBy("offset").collect()
    assert [r.error for r in whole] == [None] * docs.count()
    archive = next(Path(folder.removeprefix("file://")).glob("*.tar"))
    raw = bytearray(archive.read_bytes())
    raw[whole[5].offset + 10] ^= 1
    archive.write_bytes(raw)
    again = media.read_media(spark, folder, range_bytes=4096).orderBy("offset").collect()
    assert [k for k, r in enumerate(again) if r.error] == [5] and again[5].media is None and again[5].attempts == 3
    assert [bytes(r.media) for k, r in enumerate(again) if k != 5] == [bytes(r.media) for k, r in enumerate(whole) if k != 5]


def test_png_is_readable_by_its_format():
    payload, n = media.payload_of("some text é")
    stored = media.to_png(payload, n)
    assert media.from_png(stored) == (payload, n) and stored.startswith(b"\x89PNG") and stored.endswith(b"IEND\xaeB`\x82")
    with pytest.raises(media.MediaError):
        media.from_png(stored[:60] + b"\0" + stored[61:])


def test_shared_folder_is_the_session_setting(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
