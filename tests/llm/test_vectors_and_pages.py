"""Operators on vectors and pages against plain brute force, and the registered queries' shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import cover_tree, html_text, kdtree

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8),
       (905, [float("inf")] + [0.0] * 7), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [0.5] * 8)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in ("id", "cls", "v", "shard", "label", "rank")})


def vectors(n=700, seed=0):
    rng = np.random.RandomState(seed)
    centers = rng.randn(6, 8)
    rows = [(i, (centers[i % 6] + rng.randn(8) * [.05, .2, .35, .5, .1, .8][i % 6]).tolist()) for i in range(n)]
    return rows + [(5000 + i, centers[0].tolist()) for i in range(60)]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 90])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = vectors() + [(None if k is None else k, v) for k, v in ODD if k is not None]
    at = {k: np.array(v) for k, v in rows if usable(v) and any(v)}
    ids, links, low = sorted(at), {k: 0 for k, _ in rows}, {k: k for k, _ in rows}
    for i in ids:
        for j in ids:
            if i < j and len(at[i]) == len(at[j]) and at[i] @ at[j] / math.sqrt((at[i] @ at[i]) * (at[j] @ at[j])) >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = low[i], low[j]
                if a != b:
                    low = {k: min(a, b) if x in (a, b) else x for k, x in low.items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: (links[k], low[k], low[k] == k) for k, _ in rows}


@pytest.mark.parametrize("noise", [0.005, 0.08, 0.14])
@pytest.mark.parametrize("same", [True, False])
def test_near_copies_of_one_node_need_no_list_of_pairs(noise, same):
    rng = np.random.RandomState(11)

    def block(n):
        raw = np.ones(8) + noise * 2 * rng.randn(n, 8)
        return {"raw": raw, "unit": cover_tree.unit(raw), "weight": rng.randint(1, 4, n), "coarse": np.zeros(n, int), "fine": np.zeros(n, int)}

    a = block(700)
    b = a if same else block(300)
    link = a["unit"] @ b["unit"].T >= 0.9
    if same:
        np.fill_diagonal(link, False)
    na, nb, edges = cover_tree.traverse(a, b, same, 0.9)
    if same:
        assert ((na + nb) == link @ a["weight"]).all()
    else:
        assert (na == link @ b["weight"]).all() and (nb == a["weight"] @ link).all()
    assert len(edges) < len(na) + len(nb) and all(link[i, j] for i, j in edges)
    shift = 0 if same else len(a["unit"])
    for i in range(len(link)):  # what links is joined by the edges
        edges_of = cover_tree.spanning([*edges_at(edges, shift), *((i, int(j) + shift) for j in np.flatnonzero(link[i]))])
        assert len(edges_of) == len(edges)


def edges_at(edges, shift):
    return [(i, j + shift) for i, j in edges]


def test_near_vectors_without_ids_or_rows(spark):
    got = cover_tree.near_duplicates(frame(spark, [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, 0, True), (0, 1, 3, True), (3, 1, 3, True)]
    assert cover_tree.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("shard_rows", [50, 16_384])
def test_top_k_equals_a_full_scan(spark, shard_rows):
    rows = vectors(300) + ODD
    at = {k: np.floor(1024 * np.array(v)).astype(np.int64) for k, v in rows if k is not None and usable(v)}
    want = set()
    for q in (k for k in at if k % 20 == 0):
        best = sorted((-int(at[q] @ at[k]), k) for k in at if k != q and len(at[k]) == len(at[q]))[:10]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    got = kdtree.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 10, shard_rows=shard_rows).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_nothing(spark):
    assert kdtree.top_k(frame(spark, []), F.lit(True)).collect() == []
    assert kdtree.top_k(frame(spark, [(1, [1.0])]), F.lit(True)).collect() == []


ARTICLE = "<article><h1>Head &amp; line</h1><p>First, long\n and  winding paragraph. It goes on.<br>Next line.<p>Short.</article>"
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav>"
     f"<!-- ad --><div class='ad'>Buy, now.</div>{ARTICLE}<footer>&copy; me.</footer>", "Head & line\nFirst, long and winding paragraph. It goes on. Next line.\nShort."),
    (f"<body><div class='cookie-notice'>We use cookies, sorry.</div><main>{ARTICLE}<section id=comments><p>I agree, all of it.</p></section></main>"
     "<aside>More, more.</aside><form><p>Mail?</p></form>", "Head & line\nFirst, long and winding paragraph. It goes on. Next line.\nShort."),
    ("<div class=sidebar><p>Side, text.</p></div><div><h2>Title</h2><p>A paragraph, with words. And more; quite long it is.</p><p>Two.</p></div>",
     "Title\nA paragraph, with words. And more; quite long it is.\nTwo."),
    ("", ""), (None, ""), ("<p", ""), ("no markup, just text.", "no markup, just text."), ("<script>x", ""),
    ("<article><p>&lt;b&gt; &#233;&hellip; &nbsp; x</p></article>", "<b> é… x"),
]


def test_page_text(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.where("false")).collect() == []


CARD = "<article class=card><h3><a href=x>Other story</a></h3><p>A small teaser.</p></article>"
BODY = "".join(f"<p>Sentence {i} of the body, with words; and quite long, as bodies are. It goes on, and on.</p>" for i in range(8))


@pytest.mark.parametrize("page", [f"<div class=body>{BODY}</div>{CARD * 3}", f"{CARD}<div class=body>{BODY}</div>",
                                  f"<div class=body>{BODY}{CARD}</div>"])
def test_a_body_beside_card_articles_is_kept(page):
    assert html_text.main_text(page).count("of the body") == 8


def test_ratios_choose_inside_main():
    page = f"<main><div class=text>{BODY}</div><div class=after>{BODY}</div><div class=x><i>and</i></div><div class=y>ok</div><div class=z>go</div></main>"
    found = html_text.main_text(page)
    assert found.count("of the body") == 16 and not found.endswith("go")


def test_long_page_is_read_whole():
    page = "<body>" + "<div><p>" * 500 + "<article>" + "<p>A sentence, of words.</p>" * 20_000 + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999


def test_pipeline_stages_on_the_smallest_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(120)
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept.select("doc_id").distinct().count()
        kept = stage(spark, kept, folder)
        assert kept.select("doc_id").distinct().count() <= before
        assert name == "byte_bpe" or kept.columns == docs.columns
    text = dict(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).collect())
    rows = kept.collect()
    assert rows and all(r["decoded_sha256"] == text[r["doc_id"]] for r in rows)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
