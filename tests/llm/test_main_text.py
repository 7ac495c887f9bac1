"""Main text of pages whose names or attributes only look like those of menus, notices and unseen parts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from sensorlens.llm import common, html_text


@pytest.mark.parametrize(
    "html",
    [
        "<div class='site has-sidebar'><article><p>kept</p></article></div>", "<div class='content no-sidebar'><p>kept</p></div>", "<article class='post category-social'><p>kept</p></article>",
        "<article class='post tag-advertising'><p>kept</p></article>", "<article class='hentry has-comments'><p>kept</p></article>", "<div class='page side-by-side'><p>kept</p></div>",
        "<form action='x'><nav>no</nav><article><p>kept</p></article></form>", "<form action='x'><p>kept</p></form>", "<div class='sidebar'><main><p>kept</p></main></div>",
        "<p title='The hidden cost of x'>kept</p>", "<p data-title='A hidden gem'>kept</p>", "<p data-class='sidebar'>kept</p>",
        "<main><p>kept</p><article class='comment'><p>no</p></article><form><p>no</p></form></main>", "<article><p>kept</p></article><div class='related'><article><p>no</p></article></div>",
        "<p>ke<span class='ad'>BUY NOW</span>pt</p>", "<p>kept <span style='display:none'>no</span></p>", "<p>kept<b class='ad'>no</p>", "<div class='side'><p>kept</p></div>",
        "<article class='related-research'><p>kept</p></article>", "<p>kept</p><p hidden>no</p><p HIDDEN=''>no</p><p aria-hidden='true'>no</p><div class='cookie-notice'>no</div><div class='left-sidebar'>no</div><div id='nav'>no</div>",
    ],
)
def test_names_and_attributes(html):
    assert html_text.Page(html).main_text(frozenset()) == "kept"


@pytest.mark.parametrize("name", ["post-comments", "post-share", "post-nav", "post-related", "post-ad", "post-footer", "tag-cloud", "user-reviews", "comments-area", "sidebar-left", "related-posts", "social-icons"])
def test_names_that_set_apart(name):
    assert html_text.Page(f"<article><p>kept</p><div class='{name}'><p>no</p></div></article>").main_text(None) == "kept"


@pytest.mark.parametrize(
    "html",
    ["<h2 id='search-algorithms'>kept</h2>", "<h2 id='login'>kept</h2>", "<h2 id='navigation-by-stars'>kept</h2>", "<section id='related-work'><p>kept</p></section>", "<ul class='menu-items'><li>kept</li></ul>", "<p class='alert'>kept</p>", "<p>kept</p><p style='visibility:hidden'>no</p>"],
)
def test_names_that_are_content(html):
    assert html_text.Page(f"<article>{html}</article>").main_text(None) == "kept"
    assert html_text.Page(html).main_text(None) == "kept"


def _hidden(html, host):
    """The page with its containers' kinds and names hidden: one kind, classes hashed by host or none."""
    import hashlib
    import re

    def name(m):
        close, tag, rest = m[1], m[2].lower(), m[3]
        if tag not in ("article", "nav", "footer", "div", "ul", "li", "h1", "header", "main", "aside", "section"):
            return m[0]
        kind = hashlib.md5(f"{host}{tag}{rest}".encode()).hexdigest()[:8] if host else None
        return f"<{close}div" + (f" class='{kind}'" if kind and not close else "") + ">"

    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", name, html)


@pytest.mark.parametrize("classes", [True, False])
def test_main_text_without_kinds_and_names(spark, data, classes):
    """The given pages keep their texts if nothing but content tells an article from a menu, an advert or a footer."""
    common.ship_package(spark)
    pages = common.table(spark, data, "pages").selectExpr("page_id", "concat('http://h', page_id % 5, '.example/', page_id) AS url", "html")
    texts = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    rows = [(r.page_id, r.url, _hidden(r.html, r.url.split("/")[2] if classes else None)) for r in pages.collect()]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    same = sum(got[k] == texts[k] for k in texts)
    assert same == len(texts), (same, len(texts))


def test_copies_are_no_template(spark):
    common.ship_package(spark)
    story = "<p>Home of all stories</p><p>The one story.</p><p>It ends here.</p>"
    rows = [(k, "http://c.example/", f"<div>{story}</div>") for k in range(20)]
    rows += [(k, "http://c.example/", f"<div><p>Home of all stories</p><p>Other story {k}.</p><p>Its end {k}.</p></div>") for k in range(20, 30)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("The one story.\nIt ends here." in got[k] for k in range(20))
    assert all(f"Other story {k}.\nIts end {k}." in got[k] for k in range(20, 30))


def _plain_template(pages, least_pages=8, least_share=0.6):
    """Tokens of the valid classes of one host, by the vectors themselves and by every pair of occurrences."""
    seen = {}
    for p in pages:
        seen.setdefault(tuple(b[0] for b in p.blocks), []).append(p.sequence)
    pages = [min(s, key=lambda s: [html_text._signed(t) for t in s]) for s in seen.values()]
    vectors = defaultdict(list)
    for t in {t for s in pages for t in s}:
        v = tuple(s.count(t) for s in pages)
        if sum(n > 0 for n in v) >= max(least_pages, least_share * len(pages)):
            vectors[v].append(t)
    classes = []
    for c in vectors.values():
        before = defaultdict(set)
        for s in pages:
            own = [t for t in s if t in set(c)]
            for a, t in zip([None, *own], own, strict=False):
                before[t].add(a)
        heads = [t for t in c if len(before[t]) > 1 or None in before[t]]
        for t in heads:
            chain = [t]
            while nxt := [u for u in c if before[u] == {chain[-1]}]:
                chain += nxt
            classes.append(chain)
    classes = [c for c in classes if len(c) > 1]
    name = {id(c): html_text._signed(c[0]) for c in classes}
    facts = defaultdict(list)
    for s in pages:
        at = {id(c): [k for k, t in enumerate(s) if t in set(c)] for c in classes}
        here = [c for c in classes if at[id(c)]]
        rounds = {id(c): [at[id(c)][k : k + len(c)] for k in range(0, len(at[id(c)]), len(c))] for c in here}
        cut = lambda c, p: any(r[0] < k < r[-1] for r in rounds[id(c)] for k in at[id(p)])
        for c in here:
            orders = {tuple(s[k] for k in r) for r in rounds[id(c)]}
            good = len(orders) == 1 and len(set(min(orders))) == len(c) == len(min(orders))
            good &= not any(p is not c and cut(c, p) and cut(p, c) and (len(c), -name[id(c)]) < (len(p), -name[id(p)]) for p in here)
            around = []
            for p in here:
                if p is c or cut(c, p):
                    continue
                gaps = [max((k for k in at[id(p)] if k < r[0]), default=None) for r in rounds[id(c)]]
                numbers = {(0 if g is None else at[id(p)].index(g) + 1) % len(p) for g in gaps}
                if len(numbers) == 1 and numbers != {0}:
                    around.append((min(at[id(p)][at[id(p)].index(g) + 1] - g for g in gaps), name[id(p)], *numbers))
            facts[id(c)].append((good, orders, min(around, default=(0, 0, 0))[1:]))
    return {t for c in classes for f in [facts[id(c)]] if all(g for g, _, _ in f) and len({min(o) for _, o, _ in f}) == 1 and len({a for *_, a in f}) == 1 for t in c}


def _plain_main(pages, share=0.6):
    """The deepest element with most of the text outside links and two blocks a page, over the different pages."""
    seen = {}
    for p in pages:
        seen.setdefault(tuple(b[0] for b in p.blocks), p)
    facts = defaultdict(lambda: [0, 0, 0, 0])
    for p in seen.values():
        for spot, depth, mass, blocks in p.spots():
            f = facts[spot]
            f[0], f[1], f[2], f[3] = depth, f[1] + mass, f[2] + blocks, f[3] + 1
    whole = sum(f[1] for f in facts.values() if f[0] == 0)
    held = [(f[0], html_text._signed(spot), spot) for spot, f in facts.items() if f[1] >= share * whole > 0 and f[2] >= 2 * f[3] and f[3] >= share * len(seen)]
    return max(held)[2] if held else None


def _host_pages(seed):
    """Pages of a made-up host: a nested template, a part that repeats, blocks in most pages, and an order that isn't kept."""
    draw = random.Random(seed)
    word = lambda: " ".join(draw.choices(["la", "le", "lo", "mi", "mu", "ra"], k=4))
    fixed = [f"fixed {seed} {k}" for k in range(6)]
    container = draw.choice(["div class='text'", "article", "main"])
    out = []
    for k in range(draw.randint(6, 24)):
        menu = "".join(f"<li><a>{word()}</a></li>" for _ in range(draw.randint(1, 4)))
        story = "".join(draw.choice(["<p>{}</p>", "<p>{}</p><p><i>{}</i></p>"]).format(word(), word()) for _ in range(draw.randint(1, 4)))
        some = f"<p>{fixed[3]}</p><p>{fixed[4]}</p>" if draw.random() < 0.8 else ""
        pair = [f"<h3>{fixed[1]}</h3>", f"<h4>{fixed[2]}</h4>"]
        if draw.random() < 0.3 and seed % 2:
            pair.reverse()
        tags = container.split()[0]
        out.append(f"<div><ul>{menu}</ul><p>{fixed[0]}</p><{container}><h1>{word()} {k}</h1>{pair[0]}{story}{pair[1]}{some}</{tags}><div class='end'><p>{fixed[5]}</p><p>{word()}</p></div></div>")
    return out + out[:3]


def test_template_is_that_of_plain_deduction(spark):
    common.ship_package(spark)
    hosts = {f"h{seed}.example": _host_pages(seed) for seed in range(14)}
    rows = [(k, f"http://{h}/{k}", x) for h, pages in hosts.items() for k, x in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.host: {t % (1 << 64) for t in r.template} for r in html_text.templates(html_text.token_table(df)).collect()}
    got = Counter((r.url, r.text) for r in html_text.main_texts(df).collect())
    want, changed = Counter(), 0
    for h, pages in hosts.items():
        parsed = [html_text.Page(x) for x in pages]
        template, main = _plain_template(parsed), _plain_main(parsed)
        assert found.get(h, set()) == template
        for k, p in enumerate(parsed):
            text = p.main_text(frozenset(template) or None, main)
            want[f"http://{h}/{k}", text] += 1
            changed += text != p.main_text(None, main)
            if template:
                assert "fixed" in p.main_text(None, main) and f"fixed {h[1:].split('.')[0]} 0" not in text
    assert got == want
    assert changed > 100  # of some 200: without templates they have other texts, in main elements too
    assert len(found) > 8 and any(len(found.get(h, ())) == 0 for h in hosts)
