"""Region scoping and the account dimension.

``scope_region`` narrows region, sales_reps and accounts *before* any fact is touched; facts
(orders, web_events) are never filtered here, each analysis joins them to the narrowed
accounts with the join type its semantics need. Narrowing by inner joins equals the
reference form "LEFT JOIN ... WHERE region.name = r", because that WHERE drops every row
without a region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import exprs as E
from meridian.sources.star import Star


def small(star: Star, table: str, df: DataFrame) -> DataFrame:
    """Broadcast-hint ``df``, a subset of dimension ``table`` (or that table joined to a parent
    on its key), only when the table is proven small; else leave the join to Spark."""
    return F.broadcast(df) if star.fits(table) else df


def scope_region(star: Star, region: str | None) -> Star:
    """Star limited to one region by name (bound as a literal, never spliced into SQL)."""
    if region is None:
        return star
    return star.memo(("scope", region), lambda: _scope(star, region))


def _scope(star: Star, region: str) -> Star:
    star.fits("accounts")  # counted once on the full star; a proven bound is inherited
    reg = star.region.filter(F.col("name") == F.lit(region))
    reg_ids = reg.select(F.col("id").alias("region_id"))
    reps = star.sales_reps.join(small(star, "region", reg_ids), "region_id", "left_semi")
    rep_ids = reps.select(F.col("id").alias("sales_rep_id"))
    accounts = star.accounts.join(small(star, "sales_reps", rep_ids),
                                  "sales_rep_id", "left_semi")
    return star.narrowed(region=reg, sales_reps=reps, accounts=accounts, scope=region)


def rep_dim(star: Star, how: str = "inner") -> DataFrame:
    """(rep_id, rep_name, region_name): reps joined to their region."""
    return star.memo(("rep_dim", how), lambda: _rep_dim(star, how))


def _rep_dim(star: Star, how: str) -> DataFrame:
    reg = star.region.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    reps = star.sales_reps.select(F.col("id").alias("rep_id"), F.col("name").alias("rep_name"),
                                  "region_id")
    return reps.join(small(star, "region", reg), "region_id", how).drop("region_id")


def account_dim(star: Star, how: str = "inner", *cols: str) -> DataFrame:
    """(account_id, account_name, rep_name, region_name, *cols) for accounts of the star.

    ``how="inner"`` keeps accounts with a rep in a region (the reference's inner joins);
    ``how="left"`` keeps every account, with NULL rep/region where the chain breaks.
    """
    return star.memo(("account_dim", how, cols), lambda: _account_dim(star, how, *cols))


def _account_dim(star: Star, how: str, *cols: str) -> DataFrame:
    acc = star.accounts.select(F.col("id").alias("account_id"),
                               F.col("name").alias("account_name"),
                               F.col("sales_rep_id").alias("rep_id"), *cols)
    reps = rep_dim(star, how)
    return acc.join(small(star, "sales_reps", reps), "rep_id", how).drop("rep_id")


def account_ids(star: Star) -> DataFrame:
    return star.accounts.select(F.col("id").alias("account_id"))


#: Bits of the filter of a scope's accounts: 2 MB, whatever the number of accounts.
SCOPE_BITS = 1 << 24


def _places(bits: int) -> list:
    """Two bits of the filter for an account id: (word, bit in the word)."""
    hashes = [F.pmod(F.xxhash64("account_id", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    return [(F.shiftright(h, 6).cast("int"), F.pmod(h, F.lit(64)).cast("int")) for h in hashes]


def might_be_scoped(star: Star, facts: DataFrame, bits: int = SCOPE_BITS) -> DataFrame:
    """Facts whose account may be one of the scope's: a Bloom filter of the scope's account ids, which is one value of
    ``bits`` bits however many they are, is built once and tested in the scan's tasks. All facts of the scope
    are kept, and the fewer others the fewer accounts it has for its bits (two million: one in twenty)."""
    words = bits // 64
    marks = F.inline(F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("mask")) for w, b in _places(bits)]))
    marked = account_ids(star).filter("account_id is not null").select(marks)
    every = star.accounts.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    whole = marked.unionAll(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    filled = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")).scalar()
    (w1, b1), (w2, b2) = _places(bits)
    return facts.filter((F.getbit(F.get(filled, w1), b1) == 1) & (F.getbit(F.get(filled, w2), b2) == 1))


def early_scope(star: Star, facts: DataFrame) -> DataFrame:
    """Drop facts outside the scope before aggregating them: all, by a map-side semi-join, where the scope's
    accounts are proven small, else most, by a filter of bounded size. Callers use
    this only where a later join with the scope's accounts restricts the per-account rows,
    so raw facts never meet the accounts in a shuffle join (where a hot account would skew)."""
    if star.scope is None:
        return facts
    if not star.fits("accounts"):
        return might_be_scoped(star, facts)
    return facts.join(F.broadcast(account_ids(star)), "account_id", "left_semi")


def aggregate(df: DataFrame, by: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """One-level aggregate of ``measures`` (same specification as :func:`rollup`)."""
    return df.groupBy(*by).agg(*_aggs(_FIRST, measures))


# ---- rolling facts up through the account dimension ---------------------------------------

_FIRST = {"sum": E.sum_cents, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": E.merge_cents, "count": F.sum, "min": F.min, "max": F.max}


def _aggs(kinds: dict, measures: dict[str, tuple[str, str]], merged: bool = False) -> list:
    return [kinds[k](F.col(n if merged else c)).alias(n) for n, (k, c) in measures.items()]


def accounts_fit(star: Star) -> bool:
    """Every account-keyed dimension has at most one row per account, so a proven bound on
    the accounts table bounds them all."""
    return star.fits("accounts")


def rollup(star: Star, facts: DataFrame, dim: DataFrame, by: list[str],
           measures: dict[str, tuple[str, str]], how: str = "inner",
           accounts_as: str | None = None, fact_accounts_as: str | None = None,
           states: bool = False) -> DataFrame:
    """Aggregate fact rows to the grain ``by`` through an account-keyed dimension.

    ``measures`` maps an output name to ``(kind, fact column)``; kinds are re-aggregable:
    ``sum`` (money as integer cents), ``count`` (non-NULL), ``min``, ``max``.
    ``accounts_as`` names an extra output: the number of distinct *matched* accounts;
    ``fact_accounts_as`` one more: distinct non-NULL account ids of the facts, matched or not.

    Two plans, same result, also where the dimension repeats an account:

    * the accounts are proven few: broadcast the dimension and join first (map-side);
    * otherwise: pre-aggregate the facts per account (partial + final hash aggregate, so a hot
      account collapses map-side), and join the per-account rows to the dimension.

    ``states`` says that ``facts`` hold partial aggregates already, under the fact columns' names.

    Accounts are counted as groups: one aggregate to (grain, account), one from there to the
    grain, so distinct counts need no row per distinct column.
    """
    fact_keys = [c for c in by if c in facts.columns and c != "account_id"]
    counted = accounts_as or fact_accounts_as
    if counted:
        dim = dim.withColumn("_matched", F.lit(1))
    few, first = accounts_fit(star), _MERGE if states else _FIRST
    if few:
        rows = facts.join(F.broadcast(dim), "account_id", how)
    else:
        # scoped, the join below is an inner one with the scope's accounts
        facts = facts if states else early_scope(star, facts)
        rows = facts.groupBy("account_id", *fact_keys).agg(*_aggs(first, measures))
        rows = rows.join(dim, "account_id", how)
    if not counted:
        return rows.groupBy(*by).agg(*_aggs(first if few else _MERGE, measures, merged=not few))
    per = rows.groupBy(*by, "account_id").agg(
        *_aggs(first if few else _MERGE, measures, merged=not few), F.max("_matched").alias("_matched"))
    accounts = [(accounts_as, F.when(F.col("_matched").isNotNull(), F.col("account_id"))),
                (fact_accounts_as, F.col("account_id"))]
    return per.groupBy(*by).agg(*_aggs(_MERGE, measures, merged=True),
                                *[F.count(c).alias(n) for n, c in accounts if n])
