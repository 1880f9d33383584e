"""Many languages, and embeddings of many dimensions."""

import operator
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import embed_dedup, html_mincut, langid_crf


def test_sixty_languages(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçßåøæőłžšč"
    rows = []
    for k in range(60):
        syllables = ["".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(25)]
        word = lambda s=syllables: "".join(rng.choices(s, k=rng.randint(1, 3)))
        rows += [(1000 * k + i, " ".join(word() for _ in range(rng.randint(15, 60))), f"l{k:02}") for i in range(40 if k else 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {i: x for i, _, x in rows}
    got = [(want[r.doc_id], r.lang_pred) for r in langid_crf.labelled(docs).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {p for _, p in got} == set(want.values())
    assert sum(x == p for x, p in got) >= 0.97 * len(got)
    sample = langid_crf.sample(docs)
    assert len(sample) <= 2 * langid_crf.SAMPLE_DOCS and {x for _, x in sample} == set(want.values())


def planted(rng, n, dim):
    """Unit vectors, and for each another one at a cosine from 0.950 to 0.960."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * z


@pytest.mark.parametrize("dim", [64, 384, 768, 1024])
@pytest.mark.parametrize("n", [20_000, 1_000_000])
def test_filters_of_a_vector(dim, n):
    """Few filters whatever the dimension, and close vectors share one."""
    x, y = planted(np.random.default_rng(dim), 120, dim)
    code = embed_dedup.Code(dim, *embed_dedup.code_size(n))
    a, b = [code.decode(v) for v in x], [code.decode(v) for v in y]
    assert np.mean([len(i) for i in a + b]) <= 50
    assert np.mean([len(np.intersect1d(i, j)) > 0 for i, j in zip(a, b)]) >= 0.97


def test_recall_of_a_table(spark):
    """20,000 vectors with 300 planted pairs: links as by brute force, but for a tenth at the most."""
    rng = np.random.default_rng(10)
    x, y = planted(rng, 300, 64)
    rest = rng.standard_normal((19_400, 64))
    v = np.concatenate([x, y, rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.linked(spark.createDataFrame([(i, row) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<double>")).collect()}
    links = set()
    for at in range(0, len(v), 2000):
        i, j = np.nonzero(v[at : at + 2000] @ v.T >= 0.95)
        links |= {(a + at, b) for a, b in zip(i.tolist(), j.tolist()) if a + at != b}
    assert len(links) >= 600 and len(got) == len(v)
    found = sum(n for n, _ in got.values())
    assert 0.9 * len(links) <= found <= len(links)
    assert sum(got[a][1] == got[b][1] for a, b in links) >= 0.9 * len(links)


# pages


def without_names(page: str, tags: str) -> str:
    return re.sub(rf"<(/?)({tags})\b[^>]*>", r"<\1div>", page)


ALL_TAGS = "nav|article|footer|p|h1|ul|li|div"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").dropna(subset=["html"])


@pytest.fixture(scope="module")
def weights(pages):
    return html_mincut.learned(pages)


def wrong(pages, weights, change=lambda x: x):
    """Blocks that a lookup of elements, the classifier and the cut label wrongly; the article element says what is right."""
    out = [0, 0, 0]
    for page in pages:
        truth = [b.parent.article for b in html_mincut.blocks(page)]
        found = html_mincut.blocks(change(page))
        x = html_mincut.features(found)
        cut = html_mincut.min_cut(*html_mincut.graph(found, weights))
        for k, said in enumerate(([b.parent.region.hint > 0 for b in found], [sum(map(operator.mul, v, weights)) > 0 for v in x], cut)):
            out[k] += sum(a != b for a, b in zip(said, truth, strict=True))
    return out


def test_cut_beats_lookup_and_classifier(pages, weights):
    html = [r.html for r in pages.collect()]
    assert wrong(html, weights)[2] == 0
    lookup, alone, cut = wrong(html, weights, lambda x: without_names(x, ALL_TAGS))
    assert cut <= alone < lookup and cut < lookup / 8
    lookup, alone, cut = wrong(html, html_mincut.PRIOR, lambda x: without_names(x, ALL_TAGS))
    assert cut < alone < lookup


SENTENCE = "word " * 14 + "end."


@pytest.mark.parametrize("fit", [False, True])
def test_unnamed_pages(weights, fit):
    text = lambda page: html_mincut.main_text(page, weights if fit else html_mincut.PRIOR)
    assert text(f"<nav><a>Home</a></nav><p>{SENTENCE}</p><footer>copyright</footer>") == SENTENCE
    assert text(f"<div>Home page</div><p>{SENTENCE}</p><div>Home page</div>") == SENTENCE
    assert text(f'<article><p>{SENTENCE}</p></article><div class="kommentare"><p>{SENTENCE}</p></div>') == SENTENCE
    assert text(f"<div>{'<p>' + SENTENCE + '</p>'}</div>" * 3) == " ".join([SENTENCE] * 3)


def test_weights_without_articles(spark, pages):
    assert html_mincut.learned(pages.limit(0)) == html_mincut.PRIOR
    bare = spark.createDataFrame([("u", "<p>no article here at all.</p>")] * 5, "url string, html string")
    assert html_mincut.learned(bare) == html_mincut.PRIOR
