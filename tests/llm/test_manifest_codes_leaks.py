"""Merkle manifest, vector codes and decontamination against plain brute force, with odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import decontaminate, merkle, pq
from tests.llm import edge

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lowered=False):
    def one(v):
        v = None if v is None else str(v)
        return "-" if v is None else f"{len(v.encode())}:{v}"
    text = row["text"]
    if lowered and text is not None:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return sha(*[one(row[c]) for c in FIELDS[:-1]], one(text))


def tree(hashes):
    """The root, and each leaf's siblings from below."""
    paths, at, now = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(now) > 1:
        runs = [now[i:i + 16] for i in range(0, len(now), 16)]
        for k, a in enumerate(at):
            run, i = runs[a // 16], a % 16
            paths[k].append(("".join(run[:i]), "".join(run[i + 1:])))
            at[k] = a // 16
        now = [sha(*r) for r in runs]
    return now[0], paths


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([made[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        own, subroot, paths = made[s]
        for r, path in zip(own, paths):
            path = path + up
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r, lowered=tampered)
            for a, b in path:
                now = sha(a, now, b)
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*[x for p in path for x in p]), now, now == root))
    return out


def many(spark, n=900, sources=40):
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 49, 7).otherwise(F.col("id")).alias("doc_id"),  # repeated ids, and equal rows
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("sé"), F.col("id") % sources)).alias("source"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 5 > 0, F.col("id") % 4).alias("n_chars"),
        F.concat(F.lit("Text ÄÖ "), F.col("id") % 9).alias("text"))


@pytest.mark.parametrize("which", ["odd", "many", "hot", "one", "none"])
def test_manifest_equals_plain_trees(spark, which):
    df = {"odd": lambda: edge.docs(spark), "many": lambda: many(spark), "hot": lambda: many(spark, 700).withColumn("source", F.lit("one")),
          "one": lambda: many(spark, 1), "none": lambda: many(spark).limit(0)}[which]()
    df = df.withColumns({c: F.lit(3) for c in ("tree", "rank", "hash", "up", "leaf", "root", "block", "carried")})
    got = merkle.manifest(df, FIELDS, tampered={"text": merkle.lower_ascii("text")},
                          where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    key = str
    rows = [tuple(r) for r in got.drop("proof").collect()]
    assert sorted(rows, key=key) == sorted(manifest([r.asDict() for r in df.collect()]) if which != "none" else [], key=key)
    if which == "many":
        assert {r[-1] for r in rows} == {True, False}


def test_manifest_proof_is_the_path_itself(spark):
    row = merkle.manifest(many(spark, 300).withColumn("source", F.lit("one")), FIELDS).where("doc_id = 100").first()
    now = row["leaf"]
    for p in row["proof"]:
        now = sha(p["l"], now, p["r"])
    assert now == row["root"] == row["subroot"] and len(row["proof"]) == 3 and row["verified"]


def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1])
    cuts = [d * p // parts for p in range(parts + 1)]
    cut = [[r[1][a:b] for a, b in zip(cuts, cuts[1:])] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(z) // len(z) for z in zip(*[c[p] for c, m in zip(cut, mine) if m == k])] if k in mine else e
                        for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(f for f, _ in x) for x in found]
    total = {}
    for (_, _, lab), e in zip(kept, errors):
        total[lab] = total.get(lab, 0) + e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(r[0], "".join(f"{k:02x}" for _, k in x), e, total[r[2]]) for r, x, e in zip(kept, found, errors)], digest


def vectors(n=260, d=16):
    rng = np.random.RandomState(5)
    rows = [(i, (rng.randn(d) * [0.1, 0.4, 2][i % 3]).tolist(), [None, 1, 1, 2][i % 4]) for i in range(n)]
    rows += [(3, rows[3][1], 1), (3, [0.25] * d, 5), (None, [0.5] * d, None)] + [(1000 + i, [1.0] * d, 1) for i in range(90)]
    bad = [None, [], [None] + [1.0] * (d - 1), [math.nan] * d, [math.inf] * d, [1.0] * (d + 2)]
    return rows + [(2000 + i, v, 1) for i, v in enumerate(bad)]


def frame(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit(1) for c in ("id", "v", "code", "error", "of", "_hot")})


@pytest.mark.parametrize("n, d", [(260, 16), (10, 16), (40, 11), (30, 5)])
def test_codes_equal_plain_rounds(spark, n, d):
    rows = vectors(n, d)
    got, books = pq.compress(frame(spark, rows))
    want, digest = codes(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert books.sha256() == digest


def test_codes_of_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [math.nan], 2)]):
        got, books = pq.compress(frame(spark, rows))
        assert books is None and got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error"]


def test_masks_hold_the_nearest_entry():
    rng = np.random.RandomState(3)
    for n, d, wide in ((1, 3, 5), (16, 8, 40), (16, 2, 2), (200, 4, 9), (65, 1, 3)):
        book, x = rng.randint(-wide, wide + 1, (n, d)), rng.randint(-2 * wide, 2 * wide + 1, (500, d))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, best = pq._Masks(book.astype(np.int64)).nearest(x.astype(np.int64))
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        masks = pq._Masks(book).candidates(x, np.full(500, 2))
        inside = (abs(x[:, None] - book[None]) <= 2).all(axis=2)
        bits = (masks[:, np.arange(n) // 64] >> (np.arange(n) % 64).astype(np.uint64)) & np.uint64(1)
        assert (bits.astype(bool) == inside).all()


def test_codes_decode_to_their_entries(spark):
    rows = vectors(60, 16)
    df = pq.prepared(frame(spark, rows))
    books = pq.fit(df)
    back = {r["id"]: r["vector"] for r in pq.decode(pq.encode(df, books), books).collect()}
    coded = {r["id"]: r["code"] for r in pq.encode(df, books).collect()}
    for i, code in coded.items():
        want = [x / 4096 for p, b in enumerate(books.books) for x in b[int(code[2 * p:2 * p + 2], 16)]]
        assert back[i] == want


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="or more"):
        pq.compress(frame(spark, [(1, [1e9] * 8, 1)]))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def leaks(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add("null" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[at:at + size]))):
                    hit |= set(range(at, at + size))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"rare{i} and{i % 3}" for i in range(15))
ITEMS = [(1, PASSAGE), (2, "The QUICK brown fox"), (3, "東京 🙂 don't"), (4, None), (5, ""), (6, "..."), (7, "straße"), (10, PASSAGE.upper()),
         (2, "one two three"), (None, "wizards mix a potion of strange herbs and sing"), (8, "of the of the of the of the of the of the"),
         (9, "word1 of the 1 word2 of the 2 word3 of the 3 word4"), (11, "a b c d e f g"), (12, "absent " + PASSAGE)]


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_leaks_equal_plain_windows(spark, monkeypatch, most_bits):
    monkeypatch.setattr(decontaminate, "MOST_BITS", most_bits)
    docs = edge.TEXTS + [(100, PASSAGE), (101, "x " + PASSAGE[:60] + "; " + PASSAGE[30:]), (102, "of the " * 40), (103, "a b c d e f"),
                         (104, "a b c d e f g a-b,c d E f G"), (105, "STRASSE straße Straße straßen"), (106, PASSAGE.replace(" ", "\x00\x7f")),
                         (107, "it's a東京　don t ")] + [(200 + i, f"start{i} {PASSAGE} end{i}") for i in range(60)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "win", "size", "row")})
    df = edge.docs(spark, docs).withColumns({c: F.lit(1) for c in ("row", "spans", "items", "n_words", "shingle", "_salt")})
    got = decontaminate.contamination(df.repartition(5), items)
    assert sorted([tuple(r) for r in got.collect()], key=str) == leaks(docs, ITEMS)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = edge.docs(spark)
    assert sorted([tuple(r) for r in decontaminate.contamination(some, none).collect()], key=str) == leaks(edge.TEXTS, [])
    assert decontaminate.contamination(some.limit(0), none.union(spark.createDataFrame(ITEMS, none.schema))).collect() == []


def test_words_of_bytes_equal_the_pattern():
    import pyarrow as pa
    rng = np.random.RandomState(1)
    letters = list("aZ09 -_\x00\x7f\té日🙂 '")
    texts = ["".join(rng.choice(letters, rng.randint(0, 30))) for _ in range(300)] + [None, "", "x"]
    found = decontaminate.Words(pa.array(texts).slice(1))
    at = found.first
    assert [found.words(a, b) for a, b in zip(at, at[1:])] == [split(t) for t in texts[1:]]
    by_word = {}
    for w, h in zip(found.words(0, len(found.hash)), found.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_pipeline_stages_stand_odd_rows(spark, tmp_path):
    import corpus_pipeline
    from meridian.llm.common import stored

    words = [f"{a}{b}" for a in "bcdfg" for b in ("alan", "erin", "oum", "ith")]
    rows = edge.TEXTS + [(300 + i, " ".join(words[(i * k) % 20] for k in range(1, 30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({
        "lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.concat(F.lit("src"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(300 + i, int(i % 2 == 0), int(i % 9 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0), (9999, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, now, str(tmp_path)), name)
        assert out.columns == df.columns and out.count() > 0, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in now.collect()}, name
        now = out
    # each stage on all odd rows
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [tuple(r)[:2] for r in corpus_pipeline.drop_near_duplicates(spark, whole, str(tmp_path)).collect()]
    assert (1, edge.BASE) in kept and (2, edge.BASE) not in kept and (4, edge.BASE.upper()) not in kept
    assert {(5, ""), (6, None), (7, "   \n\t "), (None, None), (None, edge.BASE)} <= set(kept) and kept.count((15, "only here")) == 2
    last = corpus_pipeline.tokenize(spark, whole, str(tmp_path))
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in last.collect()), key=str)
    assert len(got) == len(rows) and (5, 0) in got and (6, 0) in got and (None, 0) in got
