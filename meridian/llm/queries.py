"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, cover_tree, ctw, decontaminate, html_text, importance, kdtree, merkle, minhash, mixing, packing, pq, toxicity
from meridian.llm.common import new_path

#: From this toxicity score on a document counts as toxic.
TOXIC_AT = 0.7

#: The mixture: two parts web to one part books; of the web half English.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {("web",): 2, ("books",): 1, ("web", "en"): 3}
MIX_SHARE, MIX_EPOCHS = 0.8, 2


def _crc_of_id(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def training_rows(labels: DataFrame) -> Column:
    """Rows that toxicity may learn from."""
    return _crc_of_id(3) != 1


def with_domain(docs: DataFrame) -> DataFrame:
    """The sources' domains: the first ten sources are web, the others books."""
    return docs.withColumn("domain", F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("books"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.where(training_rows(labels)), "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), index)
    return scored.select("doc_id", (_crc_of_id(3) == 1).alias("held_out"), F.col("toxicity_score").alias("score"),
                         (F.col("toxicity_score") >= TOXIC_AT).cast("int").alias("predicted"),
                         F.col("toxicity_evidence").alias("evidence"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(tokens, ranks).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed")
    packing.write_packed(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.read_packed(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed, least = importance.select(docs, _table(spark, sf_dir, "labels"))
    selected = F.lit(False) if least is None else F.col("quality_key") >= least
    return keyed.select("doc_id", F.col("quality_ngrams").alias("n_ngrams"), F.col("quality_log_weight").alias("log_weight"),
                        F.col("quality_key").alias("sample_key"), selected.alias("selected"))


def op8_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(_table(spark, sf_dir, "documents"), _crc_of_id(7) != 2)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "n_bytes")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents"))
    weights = mixing.weights_table(spark, MIX_LEVELS, MIX_WEIGHTS)
    return mixing.mix(docs, MIX_LEVELS, weights, MIX_SHARE, MIX_EPOCHS).select("doc_id", "leaf", "tokens", "copies")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"],
                           tampered={"text": merkle.lower_ascii("text")}, where=_crc_of_id(5) == 0)
    return made.drop("proof")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = pq.compress(_table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256() if books else ""))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_top_k": op3_top_k,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_page_text": op5_page_text,
    "op6_packed_ids": op6_packed_ids,
    "op7_quality": op7_quality,
    "op8_code_length": op8_code_length,
    "op9_near_vectors": op9_near_vectors,
    "op10_mixture": op10_mixture,
    "op11_manifest": op11_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
}

def _mixture_sql() -> str:
    """The mixture in SQL: the tree is filled level by level, then each leaf's order is cut."""
    weights = ", ".join(f"({len(p)}, '{chr(31).join(p)}', {w})" for p, w in MIX_WEIGHTS.items())
    levels, given = [], f"""given0 AS (
        SELECT '' AS path, least(CAST(floor(sum(tokens) * {MIX_SHARE}) AS BIGINT), sum(tokens) * {MIX_EPOCHS})::HUGEINT AS budget FROM words)"""
    for d in (1, 2, 3):
        path = "concat_ws(chr(31), " + ", ".join(MIX_LEVELS[:d]) + ")"
        up = "concat_ws(chr(31), " + ", ".join(MIX_LEVELS[:d - 1]) + ")" if d > 1 else "''"
        levels.append(f"""child{d} AS (
        SELECT path, any_value(up) AS up, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS capacity,
               coalesce((SELECT weight FROM weights WHERE depth = {d} AND weights.path = c.path), 1) AS weight
        FROM (SELECT {path} AS path, {up} AS up, tokens FROM words) c GROUP BY path),
    told{d} AS (
        SELECT c.*, g.budget,
               (g.budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
               >= capacity * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
        FROM child{d} c JOIN given{d - 1} g ON g.path = c.up
        WINDOW w AS (PARTITION BY c.up ORDER BY capacity::DOUBLE / weight, c.path)),
    given{d} AS (
        SELECT path, tokens, CASE WHEN filled THEN capacity ELSE
               (budget - coalesce(sum(capacity) FILTER (WHERE filled) OVER (PARTITION BY up), 0)) * weight
               // sum(weight) FILTER (WHERE NOT filled) OVER (PARTITION BY up) END AS budget
        FROM told{d})""")
    return f"""
    WITH weights(depth, path, weight) AS (VALUES {weights}),
    words AS (
        SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'books' END AS domain,
               coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
        FROM documents),
    {given},
    {", ".join(levels)},
    told AS (
        SELECT doc_id, path AS leaf, w.tokens, CASE WHEN g.tokens > 0 THEN budget // g.tokens ELSE 0 END AS epochs,
               CASE WHEN g.tokens > 0 THEN budget % g.tokens ELSE 0 END AS prefix
        FROM words w JOIN given3 g ON g.path = concat_ws(chr(31), domain, lang, source)),
    keyed AS (SELECT *, md5(concat_ws(':', '17', epochs, coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM told)
    SELECT doc_id, leaf, tokens, CAST(epochs + CAST(
           sum(tokens) OVER (PARTITION BY leaf ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - sum(tokens) OVER (PARTITION BY leaf, key) < prefix AS INT) AS BIGINT) AS copies
    FROM keyed
    """


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, levels: int) -> str:
    """Tables {name}1 to {name}<levels>: the nodes above those of {name}0 (tree, r, h), and with {name}side the
    digests left and right of each node in its run; a tree's only node stays as it is."""
    made = []
    for k in range(levels):
        made.append(f"""{name}side{k} AS MATERIALIZED (
        SELECT tree, r, h, count(*) OVER (PARTITION BY tree) > 1 AS many,
               coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
               coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
        FROM {name}{k} WINDOW run AS (PARTITION BY tree, r // 16 ORDER BY r)),
    {name}{k + 1} AS MATERIALIZED (
        SELECT tree, r // 16 AS r, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
        FROM {name}side{k} GROUP BY tree, r // 16)""")
    return ",\n    ".join(made)


def _manifest_sql(levels: int = 6, above: int = 3) -> str:
    """The manifest in SQL, each level written out: 16 ** levels rows a source, 16 ** above sources."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(parts) + ")"

    joins, sides = [], []
    for k in range(levels):
        joins.append(f"JOIN bside{k} AS s{k} ON s{k}.tree IS NOT DISTINCT FROM d.tree AND s{k}.r = d.r // {16 ** k}")
        sides.append(f"s{k}")
    for k in range(above):
        joins.append(f"JOIN fside{k} AS g{k} ON g{k}.r = t.r // {16 ** k}")
        sides.append(f"g{k}")
    steps = []  # one level at a time, which keeps the text short
    for i in range(len(sides)):
        was = f"f{i - 1}" if i else "other"
        steps.append(f"CASE WHEN m[{i + 1}] THEN sha256(l[{i + 1}] || {was} || r[{i + 1}]) ELSE {was} END AS f{i}")
    chain = "\n".join(f"    , fold{i} AS (SELECT *, {step} FROM {f'fold{i - 1}' if i else 'paths'})" for i, step in enumerate(steps))
    crc = ("list_reduce(flatten([[4294967295], flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: "
           "[ascii(substr(CAST(doc_id AS VARCHAR), i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))]), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)")
    return f"""
    WITH leaves AS MATERIALIZED (
        SELECT doc_id, source AS tree, {leaf("text")} AS h,
               CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(_LOWERED)} END AS other
        FROM documents),
    b0 AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM leaves),
    {_tree_sql("b", levels)},
    f0 AS MATERIALIZED (
        SELECT 0 AS tree, b.tree AS source, h, row_number() OVER (ORDER BY b.tree NULLS FIRST) - 1 AS r FROM b{levels} b),
    {_tree_sql("f", above)},
    paths AS (
        SELECT d.doc_id, d.h AS leaf, coalesce(d.other, d.h) AS other, t.h AS subroot, (SELECT h FROM f{above}) AS root,
               [{", ".join(f"{s}.many" for s in sides)}] AS m, [{", ".join(f"{s}.lft" for s in sides)}] AS l, [{", ".join(f"{s}.rgt" for s in sides)}] AS r
        FROM b0 d JOIN f0 t ON t.source IS NOT DISTINCT FROM d.tree
             {" ".join(joins)})
{chain}
    SELECT doc_id, leaf, subroot, root,
           sha256(array_to_string(flatten(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i] THEN [l[i], r[i]] ELSE [] END)), '')) AS proof_sha256,
           f{len(sides) - 1} AS folded_root, f{len(sides) - 1} = root AS verified
    FROM fold{len(sides) - 1}
    """


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Product quantisation in SQL: a table of assignments and one of moved entries for each round."""
    def assigned(k: int) -> str:
        return f"""assigned{k} AS MATERIALIZED (
        SELECT rid, part, any_value(p) AS p, arg_min(entry, far * 256 + entry) AS entry, min(far) AS far
        FROM (SELECT rid, part, p, entry, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))) AS far
              FROM cut JOIN book{k} USING (part)) GROUP BY rid, part)"""

    steps = []
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""book{k + 1} AS MATERIALIZED (
        SELECT part, entry, coalesce(moved, c) AS c FROM book{k} LEFT JOIN (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS moved
            FROM (SELECT part, entry, pos, CAST(sum(p[pos]) AS BIGINT) AS s, count(*) AS n
                  FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS pos FROM assigned{k}) GROUP BY ALL)
            GROUP BY part, entry) USING (part, entry))""")
    steps.append(assigned(rounds))
    return f"""
    WITH usable AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM usable
                          QUALIFY len(v) = first_value(len(v)) OVER (ORDER BY vec_id NULLS LAST, v)),
    cut AS MATERIALIZED (
        SELECT rid, part, v[len(v) * part // {parts} + 1:len(v) * (part + 1) // {parts}] AS p
        FROM (SELECT rid, v, unnest(range(0, {parts})) AS part FROM kept)),
    book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY rid) - 1 AS entry, p AS c FROM cut
                           QUALIFY row_number() OVER (PARTITION BY part ORDER BY rid) <= {entries}),
    {", ".join(steps)},
    coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
              FROM assigned{rounds} GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM kept JOIN coded USING (rid)
    """


ORACLE_SQL: dict[str, str] = {
    "op11_manifest": _manifest_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_decontamination": r"""
        WITH worded AS MATERIALIZED (
            SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(""" + _LOWERED.replace("text,", "coalesce(text, ''),") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(""" + _LOWERED.replace("text,", "coalesce(text, ''),") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        windows AS MATERIALIZED (
            SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS win
            FROM items WHERE len(w) > 0),
        places AS (
            SELECT rid, pos, w[pos:pos + size - 1] AS win
            FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos
                  FROM worded, (SELECT DISTINCT len(win) AS size FROM windows))),
        met AS MATERIALIZED (SELECT rid, pos, len(win) AS size, item FROM places JOIN windows USING (win)),
        hit AS (
            SELECT rid, count(DISTINCT place) AS n_hit
            FROM (SELECT rid, unnest(range(pos, pos + size)) AS place FROM met) GROUP BY rid),
        named AS (SELECT rid, list_sort(list(DISTINCT item)) AS found FROM met GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(found), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM worded LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
    """,
    "op10_mixture": _mixture_sql(),
    "op1_near_duplicates": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                                                ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g
            FROM worded),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT u, v FROM common JOIN sizes su ON su.doc_id = u JOIN sizes sv ON sv.doc_id = v
            WHERE 100 * shared >= 75 * (su.n + sv.n - shared)),
        reach(doc_id, far) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.far)
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.far) AS component_id, d.doc_id = min(r.far) AS kept
        FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id)
        GROUP BY d.doc_id
    """,
    "op9_near_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS v
            FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(vec_id, far) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT reach.vec_id, links.v FROM reach JOIN links ON links.u = reach.far)
        SELECT e.vec_id, coalesce(any_value(k.n), 0) AS n_links, min(r.far) AS component_id, e.vec_id = min(r.far) AS kept
        FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = e.vec_id JOIN reach r USING (vec_id)
        GROUP BY e.vec_id
    """,
    "op3_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 10
    """,
}
