"""Operators on documents against plain brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meridian.llm import bpe, common, components, ctw, importance, minhash, mixing, packing, toxicity
from tests.llm.edge import TEXTS, docs


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def union(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[find(a)] = find(b)
    return find, join


def expected_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    find, join = union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= 75 * len(sets[i] | sets[j]):
                join(i, j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    out = Counter()
    for i, (k, _) in enumerate(rows):
        own = low.get(find(i)) if k is not None else None
        out[(k, len(sets[i]), own, k is None or k == own)] += 1
    return out


def test_near_duplicates_edge_rows(spark):
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs(spark)).collect())
    assert got == expected_groups(TEXTS)


def test_near_duplicates_of_a_family_with_all_similarities(spark):
    rng = np.random.RandomState(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(80, rng.randint(0, 5), replace=False):
            words[at] = f"x{rng.randint(6)}"
        rows.append((1000 - i, " ".join(words)))
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == expected_groups(rows)


def test_near_duplicates_compare_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TURNS", 0)
    rng = np.random.RandomState(6)
    rows = [(i, " ".join(f"w{k}" if rng.rand() > 0.02 else f"x{rng.randint(4)}" for k in range(60))) for i in range(90)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == expected_groups(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.RandomState(1)
    pool = rng.randint(0, 2**63, 700).astype(np.uint64)
    a, b = np.unique(pool[:600]), np.unique(pool[100:])
    share = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(share - 500 / 700) < 0.15
    assert (minhash.sketch(a[:1]) == minhash.sketch(a[:1]).ravel()[0]).all(axis=1).any()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_byte_bpe_equals_tiktoken_and_decodes_back(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rng = np.random.RandomState(2)
    rows = TEXTS + [(100 + i, "".join(rng.choice(list("abcdeé  etaoin\n'0189.,#日ß"), rng.randint(1, 90)))) for i in range(150)]
    tokens = bpe.decode(bpe.encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS)
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["bytes"])) for r in tokens.collect())
    want = Counter((k, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows)
    assert got == want
    assert bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_packed_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("word_bpe_49k.json"), common.new_path(spark, "packed")
    packing.write_packed(docs(spark), folder, path, end_id=1, block_ids=500)
    got = packing.read_packed(spark, folder).orderBy("start").collect()
    tok, start = Tokenizer.from_file(path), 0
    assert [r["doc_id"] for r in got] == [None, None] + sorted(k for k, _ in TEXTS if k is not None)
    known = defaultdict(list)
    for k, t in TEXTS:
        known[k].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids) and ids in known[r["doc_id"]]
        start += len(ids)
    empty = common.new_path(spark, "packed")
    packing.write_packed(docs(spark, []), empty, path, end_id=1)
    assert packing.read_packed(spark, empty).collect() == []


@pytest.mark.parametrize("bits", range(1, 33))
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.RandomState(bits).randint(0, 2**min(bits, 31), 501)
    data = packing.pack(ids, bits)
    assert len(data) == -(-501 * bits // 8)
    assert (packing.unpack(data, bits, 0, 501) == ids).all() and (packing.unpack(data, bits, 77, 303) == ids[77:303]).all()
    assert packing.width(2**bits) == bits


def test_code_length_equals_a_plain_context_tree(spark):
    rows = [(i, t) for i, t in TEXTS if i != 11] + [(50, "an unseen thing"), (51, "the lazy fox")]
    trains = F.coalesce(F.col("doc_id"), F.lit(0)) < 50
    got = ctw.score(docs(spark, rows), trains).collect()
    depth, counts, kids = ctw.DEPTH, defaultdict(lambda: [0, 0]), defaultdict(set)

    def text(t):
        return bytes(depth) + b" ".join(ctw.words_of(t)) + b"\xff"

    heard, ends = Counter(), 0
    for k, t in rows:
        if (k or 0) < 50:
            heard.update(ctw.words_of(t))
            ends += 1
            b = text(t)
            for p in range(depth, len(b)):
                for i in range(8):
                    node, bit = (1 << i) | (b[p] >> (8 - i)), (b[p] >> (7 - i)) & 1
                    for d in range(depth + 1):
                        counts[b[p - d:p], node][bit] += 1
                        if d:
                            kids[b[p - d + 1:p], node].add(b[p - d:p])

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*counts.get((c, node), (0, 0)))
            if len(c) < depth:
                own = np.logaddexp(own, sum(weighted(x, node) for x in kids.get((c, node), ()))) - math.log(2)
            memo[c, node] = own
        return memo[c, node]

    def probability(c, node, bit):
        p = None
        for d in range(depth, -1, -1):
            x = c[depth - d:]
            n = counts.get((x, node), (0, 0))
            own = (n[bit] + .5) / (sum(n) + 1)
            if p is None:
                p = own
            else:
                w = math.exp(kt(*n) - math.log(2) - weighted(x, node))
                p = w * own + (1 - w) * p
        return p

    total, distinct = sum(heard.values()) + ends, len(heard) + 1
    want = {}
    for k, t in rows:
        b, words = text(t), ctw.words_of(t)
        score = sum(math.log10(probability(b[p - depth:p], (1 << i) | (b[p] >> (8 - i)), (b[p] >> (7 - i)) & 1))
                    for p in range(depth, len(b)) for i in range(8)) if len(b) < 400 else None
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(heard[w] for w in words), ends])
        want.setdefault(k, []).append((len(words) + 1, sum(heard[w] > 0 for w in words) + 1, base, score))
    for r in got:
        assert r["train_tokens"] == total
        assert any((n, m) == (r["n_tokens"], r["n_known"]) and math.isclose(base, r["base_score"], rel_tol=1e-9)
                   and (s is None or math.isclose(s, r["score"], rel_tol=1e-5, abs_tol=1e-6)) for n, m, base, s in want[r["doc_id"]]), r
    assert ctw.score(docs(spark, []), trains).collect() == []


def test_nearest_examples_equal_a_full_scan():
    rng = np.random.RandomState(3)
    terms = [f"t{i}" for i in range(50)]
    examples = [(i, int(rng.rand() < .4), {t: rng.randint(1, 4) for t in rng.choice(terms, rng.randint(0, 6), replace=False)})
                for i in range(600)]
    made = toxicity.Examples.of(pa.table({"id": [e[0] for e in examples], "label": [e[1] for e in examples],
                                          "term": pa.array([list(e[2]) for e in examples], pa.list_(pa.string())),
                                          "n": pa.array([list(e[2].values()) for e in examples], pa.list_(pa.int32()))}))
    index = toxicity.build(made, rng.randint(1, 300, len(made.names)), 1000, {0: 500, 1: 200})
    counts = {e[0]: e[2] for e in examples}

    def dense(c):
        out = np.zeros(len(terms))
        at, w = index.vector(c)
        out[at] = w
        return out

    table = np.array([dense(counts[i]) for i in index.ids])
    for _ in range(200):
        query = {t: rng.randint(1, 4) for t in rng.choice(terms, rng.randint(0, 10), replace=False)}
        cos = np.round(table @ dense(query), 12)
        want = [i for i in np.lexsort((np.arange(len(cos)), -cos)) if cos[i] > 0][:toxicity.K]
        assert [i for _, i in index.nearest([index.vector(query)])[0]] == want


def test_toxicity_edge_rows_and_held_out_accuracy(spark):
    rng = np.random.RandomState(4)
    vocabulary = [f"plain{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        if i % 5 == 0:
            words[3:5] = rng.choice(["vile", "nasty", "rotten"], 2)
        rows.append((i + 100, " ".join(words)))
        marks.append((i + 100, int(i % 5 == 0)))
    both = docs(spark, rows + TEXTS)
    labels = spark.createDataFrame(marks + [(None, 1), (101, None)], "doc_id long, toxic int")
    index = toxicity.fit(both, labels.where("doc_id is null or doc_id % 3 <> 1"), "toxic")
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(both, index).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 600 + 17
    held = [(got[k], y) for k, y in marks if k % 3 == 1]
    assert all((s >= 0.7) == bool(y) for s, y in held)
    none = toxicity.fit(both, labels.where("false"), "toxic")
    assert {r["toxicity_score"] for r in toxicity.score(docs(spark), none).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), index).collect() == []


def test_importance_keeps_clean_and_drops_junk(spark):
    rng = np.random.RandomState(7)
    rows, marks = [], []
    for i in range(400):
        words = rng.choice([f"w{k}" for k in range(200)], 50)
        junk = i % 6 == 0
        rows.append((i, " | ".join(words) if junk else " ".join(words)))
        marks.append((i, int(not junk)))
    labels = spark.createDataFrame(marks[:200] + [(None, 1)], "doc_id long, quality int")
    df = docs(spark, rows + [(1000 + k, t) if k is not None else (k, t) for k, t in TEXTS])
    keyed, least = importance.select(df, labels)
    got = {r["doc_id"]: r["quality_key"] >= least for r in keyed.collect()}
    assert all(got[k] == bool(y) for k, y in marks)
    everything, least = importance.select(df, labels.where("false"))
    assert everything.where(F.col("quality_key") >= least).count() == df.count()
    assert importance.select(docs(spark, []), labels)[1] is None


def test_kth_largest_is_exact(spark):
    values = [float(v) for v in np.random.RandomState(8).randint(0, 40, 300)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 17, 150, 302):
        assert common.kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df, "x", 303) is None and common.kth_largest(df, "x", 0) is None


def water(capacity, weight, budget):
    """Plain water-filling by repeated rounds."""
    full, budget = set(), min(budget, sum(capacity.values()))
    while True:
        rest = budget - sum(capacity[c] for c in full)
        share = sum(weight[c] for c in capacity if c not in full)
        more = {c for c in capacity if c not in full and rest * weight[c] >= capacity[c] * share}
        if not more:
            return {c: capacity[c] if c in full else rest * weight[c] // share for c in capacity}
        full |= {min(more, key=lambda c: (capacity[c] / weight[c], c))}


def test_mixture_budgets_and_prefixes(spark):
    rng = np.random.RandomState(9)
    rows = [(i, " ".join(["t"] * int(rng.randint(0, 30))), f"d{i % 2}", f"l{rng.randint(3)}") for i in range(500)] + [
        (None, "t t", "d1", None), (600, None, None, "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string")
    weights = {("d0",): 3, ("d1",): 1, ("d0", "l0"): 5}
    table = mixing.weights_table(spark, ["domain", "lang"], weights)
    got = mixing.mix(df, ["domain", "lang"], table, 0.7, 2).collect()
    assert len(got) == len(rows)
    tokens, total = defaultdict(int), sum(len((t or "").split()) for _, t, _, _ in rows)
    for _, t, d, l in rows:
        tokens[(d or "", l or "")] += len((t or "").split())
    tops = {d: 2 * sum(n for k, n in tokens.items() if k[0] == d) for d, _ in tokens}
    given = water(tops, {d: weights.get((d,), 1) for d in tops}, int(total * 0.7))
    taken = defaultdict(int)
    for r in got:
        taken[tuple(r["leaf"].split("\x1f"))] += r["tokens"] * r["copies"]
    for d in tops:
        leaves = {k: 2 * n for k, n in tokens.items() if k[0] == d}
        for k, budget in water(leaves, {k: weights.get(k, 1) for k in leaves}, given[d]).items():
            assert budget <= taken[k] < budget + 60 or taken[k] == 2 * tokens[k]  # a prefix ends with a whole document
    assert mixing.mix(df.where("false"), ["domain", "lang"], table).collect() == []


def test_every_term_of_the_examples_is_in_their_vectors(spark):
    rows = [(i, f"calm{'abcdefghi'[i % 9]} talk{'abcdefg'[i % 7]} word{'x' * i}") for i in range(60)]
    rows += [(100, "frimp calmb talkb"), (101, "frimp calmc talkc"), (200, "so frimp indeed"), (201, "wordxxxxxxx unheard")]
    labels = spark.createDataFrame([(k, int(k >= 100)) for k, _ in rows if k < 200], "doc_id long, toxic int")
    index = toxicity.fit(docs(spark, rows), labels, "toxic")
    assert set(index.terms) == {w for k, t in rows if k < 200 for w in t.split()}
    got = {r["doc_id"]: [e["id"] for e in r["toxicity_evidence"]] for r in toxicity.score(docs(spark, rows), index).collect()}
    assert sorted(got[200]) == [100, 101] and got[201] == [7]


def test_raw_model_counts_documents_without_labels(spark):
    rows = [(i, f"good words here {'abc'[i % 3]}") for i in range(30)] + [(100 + i, "bad junk there") for i in range(10)]
    rows += [(1000 + i, "strange tongue spoken") for i in range(200)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i < 1000], "doc_id long, quality int")
    ratio, share = importance.fit(df, labels)
    assert share == 0.75
    hashes = importance._Hashes()
    total = np.zeros(importance.BUCKETS)
    for _, t in rows:
        np.add.at(total, importance.ngrams(t, hashes), 1)
    raw = (total + importance.SMOOTHING) / (total + importance.SMOOTHING).sum()
    assert np.isclose((raw * np.exp(ratio)).sum(), 1)  # a model over the raw one
    weight = {t: ratio[importance.ngrams(t, hashes)].sum() for t in ("good words here", "bad junk there", "strange tongue spoken")}
    assert weight["good words here"] > 1 and max(weight["bad junk there"], weight["strange tongue spoken"]) < -1


def test_mixture_keeps_rows_under_a_weight_of_zero(spark):
    rows = [(i, "t t t", f"d{i % 2}", f"l{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string")
    table = mixing.weights_table(spark, ["domain", "lang"], {("d0",): 0, ("d1", "l1"): 0})
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, ["domain", "lang"], table, 1.0, 2).collect()}
    assert got == {i: 2 if d == "d1" and l != "l1" else 0 for i, _, d, l in rows}
