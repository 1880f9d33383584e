"""Chat formatting, HTML extraction, embedding dedup, components and the pipeline."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, embed_dedup, html_mincut
from graphloom.llm.components import components
from graphloom.llm.queries import HOSTILE, op6_chat_formatting

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["\\", "#", "<", ":", "</turn>\n", "### ", "<next>", "\\e", "\\h", "\\l", "\\c", "é", "a", "\n", " ", ": ", HOSTILE]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a: b", "<x>", "\\c#", "", None]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(0, 9)))])))
    rows += [(50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (50, None, "user", "first"), (None, 0, "assistant", "no id"), (51, 0, "user", "q")]
    rows += [(52, t, "assistant", f"turn {t} ") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("n_turns", "_turns", "formatted", "turns")])
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    text = chat.formatted(df).filter("conv_id = 52").first()
    assert text.formatted.count("### ") == 1 and len(text.loss_spans) == 3000
    plain = lambda t: t.replace("\\l", "<").replace("\\h", "#").replace("\\e", "\\")
    for r in chat.formatted(df).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=key)
        assert [plain(r.formatted[s.start - 1 : s.start - 1 + s.length]) for s in r.loss_spans] == [x[3] or "" for x in own if x[2] == "assistant"]
        assert all(r.formatted[s.start - 1 + s.length :].startswith(("<next>", "</turn>")) for s in r.loss_spans)
    assert chat.formatted(df.limit(0)).collect() == []


def test_chat_query(spark):
    got = {r.conv_id: r for r in op6_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(HOSTILE)
    assert got[-7].turns_sha256 == sha(f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n") and got[-7].loss_sha256 == sha(HOSTILE)


PAGE = """<html><body class="has-sidebar"><header><div>My Site</div><p>Welcome to the long header text of the site, which is here.</p></header>
<div class="cookie-notice"><p>We use cookies. Please accept them all to go on reading this site today.</p></div><nav><a href=/>Home</a></nav>
<main><article><header><h1>Real title</h1></header><p>First   paragraph of <b>t</b>he art&eacute;cle &amp; more.<p>Second<br>one.<!-- <p>no</p> -->
<ul><li>item one is here<li>item two <a href="x>y">link</a> too</ul><div class="ad">buy now</div><script>var t="</p>";</script><p>Short.</p></article>
<section id="comments"><p>I think that this is a really nice article and I have read all of it, thanks.</p></section></main>
<aside>side bar stuff. And more.</aside><form>Name <input><button>Go</button><textarea>x</textarea></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Real title First paragraph of the artécle & more. Second one. item one is here item two link too Short."),
        ("", ""),
        ("just text, without any markup at all.", "just text, without any markup at all."),
        ("<nav><a>x</a></nav>", ""),
        ("<article><p>open one.<p>open &lt;two&gt; &#233;", "open one. open <two> é"),
        ("<article><p>a</i></p></div><p>b</article>", "a b"),
        ("<article><p>cut <scr", "cut"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_pages(page, text):
    assert html_mincut.main_text(page) == text


def test_page_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", ""), (4, "w", "<article>" + "<p>word word word.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, html_mincut.extracted(df).collect()))
    assert [r[3] for r in got] == [len(r[2]) for r in got]
    assert got[1][2] == got[2][2] == got[3][2] == "" and got[4][2].count("word.") == 5000
    assert html_mincut.extracted(df.limit(0)).collect() == []


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        a, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        ties = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(y if k else x for k, x, y in zip(s, a, b)) + sum(c for i, j, c in ties if s[i] != s[j])  # noqa: B023,E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(html_mincut.min_cut(a, b, ties)), best, abs_tol=1e-9)


def test_labels_are_the_best_of_all(spark):
    """Every labelling of small pages is tried: none costs less than the one by the cut, and main_text is what it keeps."""
    rng = random.Random(8)
    bits = ["<p>{}.</p>", "<div>{}</div>", "<li><a href=x>{}</a></li>", "<div class=ad>{}!</div>", "<nav><a>{}</a></nav>", "<article><h2>{}</h2>", "</article>", "<section><p>{}</p>", "</section>", "<footer>&copy; {}</footer>"]
    seen = 0
    for _ in range(60):
        page = "".join(rng.choice(bits).format(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 2, 12, 40])))) for _ in range(rng.randint(1, 9)))
        found = html_mincut.blocks(page)
        a, b, ties = html_mincut.graph(found)
        n = len(a)
        if n > 12:
            continue
        cost = lambda s: sum(y if k else x for k, x, y in zip(s, a, b)) + sum(c for i, j, c in ties if s[i] != s[j])  # noqa: B023,E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n)) if n else 0
        keep = html_mincut.min_cut(a, b, ties)
        assert math.isclose(cost(keep), best, rel_tol=1e-9, abs_tol=1e-6)
        assert html_mincut.main_text(page) == " ".join(x.text for x, k in zip(found, keep) if k)
        seen += n > 2
    assert seen > 20


def test_cut_decides_on_pages(spark):
    """By themselves many blocks would be called the wrong thing: the cut changes some of one in twenty labels and more, towards the article."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    blocks = [(r.html, *x) for r in rows for x in html_mincut.labelled(r.html)]
    changed = [x for x in blocks if x[2] != x[3]]
    assert len(changed) > 0.05 * len(blocks)
    inside = lambda page, text: text in " ".join(re.sub(r"<[^>]*>", " ", html.unescape(page.split("<article>")[1].split("</article>")[0])).split())
    right = [inside(page, text) == cut for page, text, _, cut in changed]
    assert sum(right) > 0.98 * len(right)


SIDE = """<body><div class="site-header"><p>My great site, where all is said.</p></div><div id="sidebar"><p>Sidebar prose of many words that looks just like an article, and goes on for a while so that it is long.</p></div>
<main><div class="post-content"><h2>Title</h2><p>First paragraph with enough words to be one.</p><p><a href=x>A paragraph that is one link</a></p><ul><li>short</li><li>item</li></ul>
<div class="newsletter-signup"><p>Subscribe to our letter to get all of it by mail.</p></div><p>Last.</p></div><div class="comments"><p>A reader says a lot here, in whole sentences, with many words and a point at the end.</p></div></main></body>"""


def test_sidebars_comments_and_lists():
    assert html_mincut.main_text(SIDE) == "Title First paragraph with enough words to be one. A paragraph that is one link short item Last."


def brute_links(rows):
    units = [embed_dedup.unit(v) if i is not None else None for i, v in rows]
    near = lambda a, b: units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= 0.95
    n, up = len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            if near(a, b):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [(x, k, least.get(root(i)) if x is not None else None, x is None or x == least[root(i)]) for i, ((x, _), k) in enumerate(zip(rows, links))]


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(150)]
    out += [out[0] + rng.standard_normal(16) * 0.12 for _ in range(60)]
    out += [out[i] + rng.standard_normal(16) * s for i in range(1, 40) for s in (0.2, 0.3)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [rows[7], rows[7]]
    zero, nan, inf = [0.0] * 16, [math.nan] * 16, [math.inf] * 16
    return rows + [(2000, None), (2001, zero), (2002, zero), (2003, nan), (2004, nan), (2005, inf), (2006, [None] * 16), (2007, []), (2008, [1.0, 2.0]), (2009, [2.0, 4.0]), (None, rows[5][1]), (2010, [-0.0, 1.0]), (2011, [0.0, 1.0])]


@pytest.mark.parametrize("chunk", [8, 512])
def test_embeddings(spark, chunk):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(0).alias(c) for c in ("label", "n_links", "id", "v", "h1")])
    got = sorted(map(tuple, embed_dedup.linked(df, chunk=chunk).collect()), key=repr)
    assert got == sorted(brute_links(rows), key=repr)
    assert embed_dedup.linked(df.limit(0)).collect() == []


def test_embedding_recall(monkeypatch):
    """Pairs at cosines just over the limit share a filter."""
    rng, hit, tried = np.random.default_rng(1), 0, 300
    code = embed_dedup.Code(64, *embed_dedup.code_size(50_000))
    for _ in range(tried):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = 0.952 * x + math.sqrt(1 - 0.952**2) * y / np.linalg.norm(y)
        hit += bool(set(code.decode(x)) & set(code.decode(y)))
    assert hit >= 0.97 * tried
    monkeypatch.setattr(embed_dedup, "LEAST", 1)
    full = embed_dedup.Code(8, 2, 5)
    for _ in range(20):
        x = embed_dedup.unit(rng.standard_normal(8))
        y = x @ full.turn
        want = [i * 5 + j for i in range(5) for j in range(5) if full.books[0][i] @ y[:4] + full.books[1][j] @ y[4:] >= full.least]
        assert full.decode(x).tolist() == want or not want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(70)] + [(500, rng.randint(501, 700)) for _ in range(150)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(250)] + [(9, 9), (3, 2)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_documents import brute_components, brute_fingerprint, verdicts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    rows = [tuple(r) for r in docs.collect()]
    _, _, kept = verdicts(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if k < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert sorted(ids) == sorted(r[0] for r, x in zip(rows, kept) if x)
        if name == "simhash_near_dedup":
            had = [(r.doc_id, brute_fingerprint(r.text)) for r in before.collect()]
            comp = brute_components([i for i, _ in had], lambda a, b: bin(had[a][1] ^ had[b][1]).count("1") <= 4)
            assert sorted(ids) == sorted(i for (i, _), c in zip(had, comp) if i == c)
        if name in ("line_dedup", "byte_bpe"):
            assert sorted(ids) == sorted(r.doc_id for r in before.select("doc_id").collect())
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in docs.collect())
