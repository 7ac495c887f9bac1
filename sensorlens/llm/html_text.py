"""Main text of web pages by template deduction over the pages of a host.

1. Tokens of a page are its elements, by their path, and its text blocks, by path and words. Over the different pages of a
   host each token has an occurrence vector: how often it stands in each page. Tokens with equal vectors form an
   equivalence class, if there are two or more and enough pages have them.
2. A class is cut before each token that doesn't follow the same one of the class everywhere, so that what is left keeps
   its order on every page, over and over again where it repeats. Such a part, of two or more tokens, is valid if it is
   nested: no larger one cuts through it, and it lies in the same slot of the same one on every page. A slot is what lies
   between two neighbours. Valid classes, nested, are the host's template.
3. Text that is no token of the template lies in its slots. Which slots are the main text their content over the host's pages
   tells, not their names: the deepest element that holds most of the text outside links, in several blocks a page, is the
   host's main element. Kinds and names break ties: what is apart inside it, what an article is in it, and where a page lacks it.

Vectors are never gathered: a vector is known by the number of its pages, its sum and the XOR of a hash over (page, count),
so a class is one grouping on (host, vector) with partial sums, however many pages a host has. Order and nesting are told
page by page, and partial aggregation leaves one row for each token or class of a task.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settled

#: A comment, an element whose content is no markup (to its end tag or the end), a tag, or a declaration.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements without content, elements that stand inside a line, and elements that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("head nav header footer aside form menu button select option svg dialog object audio video canvas".split())
MAIN = frozenset(["article", "main"])
#: What names say, by their last word, behind which words of place or shape may stand (sidebar-left, comments-area). They break
#: ties: inside what the host's pages show to be their main text, and where there are too few pages to show anything.
#: Names of headings and paragraphs say what these are about, and so tell nothing; so do states of a page (has-sidebar, category-social).
_STATE = r"(?!(?:has|no|not|is|with|without|category|tag|type|format|status|term|topic)[-_](?!cloud\b))"
_BEHIND = r"(?:[-_](?:left|right|top|bottom|primary|secondary|wrap|wrapper|container|box|area|list|inner|outer|block|section|links?|icons?|buttons?|bar|widget|form|thread|title|\d+))*"
_APART = (
    r"ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promotions?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|footer|sidebar|widgets?|cookies?|consent|notices?|alerts?|popup|modal"
    r"|comments?|commentlist|replies|reply|reviews|disqus|share|sharing|social|newsletter|subscribe|signup|login|search|searchform|pagination|pager|complementary|contentinfo|tag-?cloud"
    r"|(?:related|recommended|recent|popular|similar)(?:[-_](?:posts?|articles?|stories|news|links?|pages?|reads?|reading|content|items?))?"
)
APART_NAME = re.compile(rf"{_STATE}(?:[a-z0-9]+[-_]+)*(?:{_APART}){_BEHIND}", re.I)
#: The same outside main text; inside, a header holds a title.
HEADER_NAME = re.compile(rf"{_STATE}(?:[a-z0-9]+[-_]+)*(?:header|masthead){_BEHIND}", re.I)
#: Names that take an element inside a line out of its block.
INLINE_NAME = re.compile(rf"{_STATE}(?:[a-z0-9]+[-_]+)*(?:ads?|adverts?|advertisements?|sponsors?|sponsored|promos?|share|sharing){_BEHIND}", re.I)
NAMELESS = frozenset("p h1 h2 h3 h4 h5 h6 html body blockquote pre li dt dd figure figcaption table tbody tr td th".split())
NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
NUMBER = re.compile(r"\d+")
SEED = 11


class Page:
    """``sequence``: tokens of elements and blocks in page order. ``blocks``: (token, text, container, apart, around, in form, element).
    ``elements``: (spot, parent, apart, form) of each element that holds blocks, parents first; a spot is an element's way from
    the root, with its place among siblings of its kind and names.

    ``container`` is the token of the outermost article or main around the block, 0 outside. ``around`` is what names or a
    form say of that container and what it stands in. They may set a second article apart, but not the page's only one.
    """

    __slots__ = ("blocks", "clear", "containers", "elements", "holders", "links", "sequence")

    def __init__(self, html: str):
        import xxhash

        mix = xxhash.xxh64_intdigest
        self.sequence: list[int] = []
        self.blocks: list[tuple[int, str, int, bool, bool, bool, int]] = []
        self.elements: list[tuple[int, int, bool, bool]] = [(SEED, -1, False, False)]
        self.links: list[int] = []  # characters of each block that stand in links
        self.containers: list[int] = []
        self.holders: list[int] = []  # the same as elements
        self.clear = False  # whether a container is neither apart nor around
        # name, path, container, apart by kind or unseen, apart by name, around, in form, cut out of its line, element, in a link
        stack: list[tuple[str, int, int, bool, bool, bool, bool, bool, int, bool]] = [("", 0, 0, False, False, False, False, False, 0, False)]
        held: list[str] = []
        linked: list[int] = []
        nth: dict[int, int] = {}

        def flush() -> None:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, path, main, apart, by_name, around, form, _, element, _ = next(s for s in reversed(stack) if s[0] not in INLINE)
                token = mix(f"{path}#{text}", SEED)
                self.sequence.append(token)
                self.blocks.append((token, text, main, apart or by_name, around, form, element))
                self.links.append(min(len(text), sum(linked)))
            linked.clear()

        def text_to(end: int) -> None:
            if at < end and not stack[-1][7]:
                piece = html[at:end]
                held.append(entities.unescape(piece) if "&" in piece else piece)
                if stack[-1][9]:
                    linked.append(len(held[-1].strip()))

        at = 0
        for m in MARKUP.finditer(html):
            text_to(m.start())
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE:
                flush()
            if m[2]:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if depth:
                    del stack[depth:]
                continue
            if name not in INLINE and stack[-1][0] in INLINE or name not in INLINE and any(s[0] == "p" for s in stack[-3:]):
                # A block ends an open paragraph, and what is open in a line there.
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), 0)
                if depth and stack[depth][0] == "p" and name not in VOID:
                    del stack[depth:]
            _, path, main, apart, by_name, around, form, cut, element, link = stack[-1]
            given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[4])} if m[4] else {}
            named = " ".join(given[k] for k in ("class", "id", "role") if given.get(k))
            path = mix(f"{path}>{name}.{NUMBER.sub('', named)}", SEED)
            self.sequence.append(path)
            if name in VOID or m[4].endswith("/") and name in ("path", "use"):
                continue
            words = [] if name in NAMELESS else " ".join(given[k] for k in ("class", "role") if given.get(k)).lower().split()
            if name in ("div", "aside", "ul") and given.get("id"):
                words.append(given["id"].lower())
            opens = not main and (name in MAIN or "main" in words)
            unseen = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(NONE_SHOWN.search(given.get("style", "")))
            link = link or name == "a" or bool(given.get("href"))
            if name in INLINE:
                cut = cut or unseen or any(INLINE_NAME.fullmatch(w) for w in words)
            elif name not in ("html", "body"):
                own = unseen or cut or name in APART and name != "form"
                told = any(APART_NAME.fullmatch(w) for w in words)
                apart = apart or own and not (main and name == "header")
                by_name = by_name or told or not (main or opens) and any(HEADER_NAME.fullmatch(w) for w in words)
                cut = False
                if name == "form":
                    by_name, form = by_name or bool(main), True
                spot = mix(f"{self.elements[element][0]}>{name}.{NUMBER.sub('', named)}", SEED)
                nth[spot] = nth.get(spot, 0) + 1
                self.elements.append((mix(f"{spot}[{nth[spot]}]", SEED), element, (own and name != "header") or told, name == "form"))
                element = len(self.elements) - 1
            if opens:
                main, by_name, around, form = path, False, by_name or form, False
                self.containers.append(path)
                self.holders.append(element)
                self.clear |= not (apart or around)
            stack.append((name, path, main, apart, by_name, around, form, cut, element, link))
        text_to(len(html))
        flush()

    def spots(self) -> list[tuple[int, int, int, int]]:
        """(spot, depth, characters outside links, blocks) of each element, with all that stands in it."""
        depth, mass, count = [0] * len(self.elements), [0] * len(self.elements), [0] * len(self.elements)
        for (_, text, *_, element), links in zip(self.blocks, self.links):
            mass[element] += len(text) - links
            count[element] += 1
        for k, (_, parent, *_) in enumerate(self.elements[1:], 1):
            depth[k] = depth[parent] + 1
        for k in range(len(self.elements) - 1, 0, -1):
            mass[self.elements[k][1]] += mass[k]
            count[self.elements[k][1]] += count[k]
        return [(e[0], d, m, n) for e, d, m, n in zip(self.elements, depth, mass, count) if n]

    def main_text(self, template: frozenset[int] | None, main: int | None = None) -> str:
        """Text of the slots of ``template`` (None: the host has none) inside the element at the spot ``main``, if it is given and there."""
        kept, forms = [], []
        if main is not None and any(e[0] == main for e in self.elements):
            within, apart, form = [], [], []
            for spot, parent, own, is_form in self.elements:  # what stands in the main element, and in something apart there
                inside = parent >= 0 and within[parent]
                apart.append(inside and (apart[parent] or own))
                form.append(inside and (form[parent] or is_form))
                within.append(inside or spot == main)
            # Where an article or main stands inside, its kind says more than the mass of what is around it.
            finer = any(within[h] and self.elements[h][0] != main for h in self.holders)
            for token, text, *_, element in self.blocks if not finer else ():
                if within[element] and not apart[element] and not (template and token in template):
                    (forms if form[element] else kept).append(text)
            if kept or forms:
                return "\n".join(kept or forms)
        within = self.containers if not template else [c for c in self.containers if c in template]
        only = frozenset(within or self.containers)
        for token, text, container, apart, around, form, _ in self.blocks:
            if apart or (around and self.clear) or (only and container not in only) or (template and token in template):
                continue
            (forms if form else kept).append(text)
        return "\n".join(kept or forms)  # a form around the whole page is its text


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1), F.lit("")))


def token_table(pages: DataFrame) -> DataFrame:
    """``host, page, tokens, spots``: the tokens, in order, and the elements' masses of each different page of a host. ``page`` is a hash of its blocks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            marks, lists, spots = [], [], []
            for text in batch.column("html").to_pylist():
                page = Page(text or "")
                marks.append(_signed(xxhash.xxh64_intdigest(b"".join(b[0].to_bytes(8) for b in page.blocks), SEED)))
                lists.append([_signed(t) for t in page.sequence])
                spots.append([(_signed(spot), *x) for spot, *x in page.spots()])
            columns = [pa.array(marks, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(spots, spot_list)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *columns], ["host", "page", "tokens", "spots"])

    spot_list = pa.list_(pa.struct([("spot", pa.int64()), ("depth", pa.int32()), ("mass", pa.int64()), ("blocks", pa.int64())]))
    found = pages.select(host().alias("host"), "html").mapInArrow(made, "host string, page long, tokens array<long>, spots array<struct<spot: long, depth: int, mass: long, blocks: long>>")
    # Copies of a page, by its blocks, count once: what they share is no template unless other pages have it as well.
    return found.groupBy("host", "page").agg(F.min(F.struct("tokens", "spots")).alias("one")).select("host", "page", "one.tokens", "one.spots")


def main_spots(table: DataFrame, least_share: float = 0.6, least_blocks: float = 2.0) -> DataFrame:
    """``host, main``: the deepest element that holds ``least_share`` of the text outside links of the host's pages, in
    ``least_blocks`` blocks a page or more. Elements that hold over half of all stand in each other, so there is one deepest.
    """
    each = table.select("host", F.explode("spots").alias("s")).select("host", "s.*")
    sums = each.groupBy("host", "spot").agg(F.sum("mass").alias("mass"), F.sum("blocks").alias("blocks"), F.count("*").alias("pages"), F.max("depth").alias("depth"))
    whole = sums.where("depth = 0").select("host", F.col("mass").alias("all_mass"), F.col("pages").alias("all_pages"))
    held = sums.join(whole, "host").where((F.col("mass") >= least_share * F.col("all_mass")) & (F.col("mass") > 0))
    held = held.where((F.col("blocks") >= least_blocks * F.col("pages")) & (F.col("pages") >= least_share * F.col("all_pages")))
    return held.groupBy("host").agg(F.max_by("spot", F.struct("depth", "spot")).alias("main"))


def equivalence_classes(table: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """``host, classes``: the tokens of each class of a host that enough of its pages have."""
    counts = table.select("host", "page", F.explode("tokens").alias("token")).groupBy("host", "page", "token").agg(F.count("*").alias("n"))
    vectors = counts.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("mark"))
    sizes = table.groupBy("host").agg(F.count("*").alias("all_pages"))
    frequent = vectors.where(F.col("pages") >= least_pages).join(sizes, "host").where(F.col("pages") >= least_share * F.col("all_pages"))
    # A page of average size has a bounded number of tokens, and a host has at most 1 / least_share times that number here.
    classes = frequent.groupBy("host", "pages", "total", "mark").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") > 1)
    return classes.groupBy("host").agg(F.array_sort(F.collect_list("tokens")).alias("classes"))


def ordered_classes(table: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, classes``: the classes cut where their order isn't kept, each in its order, without parts of one token."""

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens_, befores, known = [], [], [], {}
            for name, tokens, lists in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "classes")), strict=True):
                if name not in known:
                    known[name] = {t: k for k, c in enumerate(lists) for t in c}
                last: dict[int, int] = {}
                for t in tokens:
                    if (c := known[name].get(t)) is not None:
                        hosts.append(name)
                        tokens_.append(t)
                        befores.append(last.get(c))
                        last[c] = t
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens_, pa.int64()), pa.array(befores, pa.int64())], ["host", "token", "before"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():  # the template's tokens of one host
                after = {r["before"]: r["token"] for r in rows if r["same"]}
                chains = []
                for r in rows:
                    if not r["same"]:
                        chains.append([r["token"]])
                        while chains[-1][-1] in after:
                            chains[-1].append(after[chains[-1][-1]])
                out.append(sorted(c for c in chains if len(c) > 1))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["host", "classes"])

    found = _with_classes(table, classes).mapInArrow(before, "host string, token long, before long")
    same = (F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))
    kept = found.groupBy("host", "token").agg(F.coalesce(same, F.lit(False)).alias("same"), F.min("before").alias("before"))
    return kept.groupBy("host").agg(F.collect_list(F.struct("token", "same", "before")).alias("rows")).mapInArrow(chained, "host string, classes array<array<long>>")


def _with_classes(table: DataFrame, classes: DataFrame) -> DataFrame:
    return table.join(classes.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).select("host", "tokens", "classes")


#: One class on one page: whether it is in order and not cut, its order's hash, and the class and slot that it lies in.
PLACE = "host string, class long, good boolean, order long, parent long, slot int"


def class_places(tokens: list[int], owner: dict[int, int], sizes: dict[int, int]) -> list[tuple[int, bool, int, int, int]]:
    """(class, in order and not cut, order hash, parent, slot) of the classes on a page. ``owner``: token -> class, by its first token."""
    import xxhash

    at: dict[int, list[int]] = {}
    own: dict[int, list[int]] = {}
    for k, t in enumerate(tokens):
        if (c := owner.get(t)) is not None:
            at.setdefault(c, []).append(k)
            own.setdefault(c, []).append(t)
    rounds = {c: [(places[k], places[min(k + sizes[c], len(places)) - 1]) for k in range(0, len(places), sizes[c])] for c, places in at.items()}
    # For each two classes: before which token of p each round of c begins and ends; equal if it lies between two of them.
    held = {(c, p): [(bisect_left(outer, a), bisect_left(outer, b)) for a, b in spans] for c, spans in rounds.items() for p, outer in at.items() if p != c}
    within = {pair: all(i == j for i, j in slots) for pair, slots in held.items()}
    out = []
    for c, places in at.items():
        order = own[c][: sizes[c]]
        good = own[c] == order * (len(places) // sizes[c]) and len(set(order)) == sizes[c]
        parent, slot, least = 0, 0, None
        for p, outer in at.items():
            if p == c:
                continue
            if within[c, p]:
                numbers = {i % sizes[p] for i, _ in held[c, p]}
                if len(numbers) == 1 and 0 not in numbers:  # between two neighbours, not outside the class or between two rounds of it
                    width = min(outer[i] - outer[i - 1] for i, _ in held[c, p])
                    if least is None or (width, p) < least:
                        parent, slot, least = p, numbers.pop(), (width, p)
            elif not within[p, c] and (sizes[c], -c) < (sizes[p], -p):
                good = False  # they cut through each other: the smaller one goes
        out.append((c, good, _signed(xxhash.xxh64_intdigest(b"".join(t.to_bytes(8, "big", signed=True) for t in order), SEED)), parent, slot))
    return out


def templates(table: DataFrame, least_pages: int = 8, least_share: float = 0.6) -> DataFrame:
    """``host, template``: the tokens of the valid classes of each host with at least ``least_pages`` different pages, from the ``token_table``."""
    classes = settled(equivalence_classes(table, least_pages, least_share), "vectors")
    classes = settled(ordered_classes(table, classes), "classes")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for name, tokens, lists in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "classes")), strict=True):
                if name not in known:
                    known[name] = {t: c[0] for c in lists for t in c}, {c[0]: len(c) for c in lists}
                rows += [(name, *x) for x in class_places(tokens, *known[name])]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PLACE.split(", ")])

    same = [F.min(c) == F.max(c) for c in ("order", "parent", "slot")]
    valid = _with_classes(table, classes).mapInArrow(placed, PLACE).groupBy("host", "class").agg((F.min("good") & same[0] & same[1] & same[2]).alias("valid"))
    valid = valid.where("valid").groupBy("host").agg(F.collect_set("class").alias("valid"))
    chosen = F.filter("classes", lambda c: F.array_contains("valid", c[0]))
    return classes.join(valid, "host").select("host", F.array_sort(F.flatten(chosen)).alias("template"))


def main_texts(pages: DataFrame, **options) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; blocks are joined by a line feed.

    A null or empty page has an empty text. Pages without a url are one host. On hosts with fewer than ``least_pages``
    different pages (8) no block is a template's; where no element holds most of the text, as on hosts with few and short pages,
    kinds and names decide alone where the main text is. Repeated rows stay rows of their own; an empty table gives no rows.
    """
    table = settled(token_table(pages), "tokens")
    found = templates(table, **options).join(main_spots(table), "host", "full")
    found = settled(found, "templates").withColumnRenamed("host", "_host")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("_at"), "html")
    joined = rows.join(found, F.col("_at") == F.col("_host"), "left").select("page_id", "url", "html", "template", "main")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset[int]] = {}
            texts = []
            for text, template, main in zip(*(batch.column(c).to_pylist() for c in ("html", "template", "main")), strict=True):
                key = tuple(template or ())
                if key not in known:
                    known[key] = frozenset(x % (1 << 64) for x in key)
                texts.append(Page(text or "").main_text(known[key] or None, None if main is None else main % (1 << 64)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
