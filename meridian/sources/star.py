"""The star of five tables every analysis runs on, and its readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meridian.sources import schema as S

# Split columns of an order: quantity and amount per product.
PRODUCTS = ("standard", "gloss", "poster")

# Dimension tables whose size is checked before anything derived from them is broadcast.
DIMS = ("region", "sales_reps", "accounts")

# Partition column of stored orders (see Star.write_tables); Spark appends it when reading.
ORDER_YEAR = "order_year"


# Rows of the dimension tables by application, place and state of their files.
_COUNTS: dict[tuple, dict[str, int]] = {}


def forget_sizes() -> None:
    """Count the dimension tables again when they are next read from a path."""
    _COUNTS.clear()


def _files(spark: SparkSession, paths: tuple[str, ...]) -> tuple:
    """(bytes, files, time of change) under each path: what tells a table that has changed under its path."""
    conf, kind = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for p in paths:
        at = kind(p)
        fs = at.getFileSystem(conf)
        held = fs.getContentSummary(at)
        found.append((held.getLength(), held.getFileCount(), fs.getFileStatus(at).getModificationTime()))
    return tuple(found)


# Column of a CSV row's time as text, and of a row that doesn't fit the schema as a whole.
CSV_TIME = "_occurred_at_text"
CSV_ROW = "_row_text"


def _csv_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All rows of a CSV table; one that doesn't fit the schema has its text in CSV_ROW, others have NULL there."""
    schema = S.TABLES[name]
    if name == "orders":
        schema = StructType([StructField(f.name, StringType()) if f.name == "occurred_at" else f for f in schema])
    schema = StructType([*schema.fields, StructField(CSV_ROW, StringType())])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
    return reader.option("columnNameOfCorruptRecord", CSV_ROW).csv(f"{path}/{name}.csv")


def _length(rows: DataFrame) -> Column:
    return F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c != CSV_ROW]))


def _read_csv(spark: SparkSession, path: str, name: str, bad_rows: str = "leave") -> DataFrame:
    """A CSV table with its fixed schema; ``orders`` with its time read from text, which may have a ``T`` and a
    zone (the wall-clock time counts), and the text itself beside it. Rows that don't fit the schema (a
    letter in a number, too few or too many fields) are left out, or end the read with ``bad_rows="fail"``."""
    rows = _csv_rows(spark, path, name)
    # only columns that are asked for are checked, so the test asks for all (no length is negative): whatever is
    # read afterwards, the same rows count
    fits = F.when(F.col(CSV_ROW).isNull(), True).otherwise(_length(rows) < 0)
    if bad_rows == "fail":
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit(f"a row of {name} does not fit its schema: "), CSV_ROW)).cast("boolean"))
    rows = rows.filter(fits).drop(CSV_ROW)
    if name != "orders":
        return rows
    wall = F.regexp_replace(F.trim("occurred_at"), r"\s*(?:Z|[+-]\d{2}:?\d{2})$", "")
    time = wall.try_cast("timestamp_ntz")
    return rows.withColumn(CSV_TIME, F.col("occurred_at")).withColumn("occurred_at", time)


@dataclass(frozen=True, eq=False)
class Star:
    """region <- sales_reps <- accounts <- orders, accounts <- web_events.

    ``orders`` holds at least ``id, account_id, occurred_at, total_amt_usd``;
    ``orders_detail`` adds the per-product split (``*_qty``, ``*_amt_usd``, ``total``). When the
    source stores the split in the orders table itself both are the same frame; the testdata
    adapter derives the split from line items, so analyses that do not need it never pay for it.

    ``scope`` is the region name when the star has been narrowed by :func:`scope_region`.
    ``broadcast_rows`` bounds what may be broadcast: a side is broadcast only after a
    row count proved it at most this size; beyond it the join is left to a shuffle join.
    """

    region: DataFrame
    sales_reps: DataFrame
    accounts: DataFrame
    orders: DataFrame
    web_events: DataFrame
    orders_detail: DataFrame | None = None
    scope: str | None = None
    #: Orders (a subset of ``orders``) to the same with their product split, where that is derived.
    detail_of: Callable[[DataFrame], DataFrame] | None = None
    broadcast_rows: int = 250_000
    #: Paths of the tables region, sales_reps and accounts; their size check is made once for a state of the files.
    place: tuple | None = None
    #: Whether the id is known to tell the orders apart, as that of a primary key; counts of distinct orders then need no shuffle of ids.
    unique_orders: bool = False
    #: States that stand for the orders and events (see meridian.plans.states).
    order_states: DataFrame | None = None
    event_states: DataFrame | None = None
    _fits: dict = field(default_factory=dict, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)  # frames derived once per star

    def memo(self, key: tuple, build):
        """The frame ``build()`` made once for this star (DataFrames are immutable)."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    @property
    def detailed_orders(self) -> DataFrame:
        return self.orders if self.orders_detail is None else self.orders_detail

    def details(self, restrict: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Orders with their product split, narrowed by ``restrict`` first: where the split comes from line items,
        only those of the orders that are left are summed."""
        if self.detail_of is None:
            return restrict(self.detailed_orders)
        return self.detail_of(restrict(self.orders))

    def fits(self, table: str) -> bool:
        """True when dimension table ``table`` (region, sales_reps or accounts) has at most
        ``broadcast_rows`` rows.

        Every frame the analyses broadcast is a subset of one of these tables, or one of them
        joined to a parent on its primary key, so this bound is the bound of what is sent.
        The three are counted together in one job; the count projects no column, so on
        Parquet it is answered from row-group metadata. Tables read from paths are counted once for an application and state of
        their files, so a table that has grown is counted again by the next star."""
        if table not in self._fits:
            spark = self.region.sparkSession
            key = self.place and (spark.sparkContext.applicationId, self.place, _files(spark, self.place))
            if key in _COUNTS:
                self._fits.update({t: _COUNTS[key][t] <= self.broadcast_rows for t in DIMS})
                return self._fits[table]
            parts = [getattr(self, t).select(F.lit(t).alias("t")) for t in DIMS]
            union = parts[0]
            for p in parts[1:]:
                union = union.unionAll(p)
            counts = dict(union.groupBy("t").count().collect())  # three rows at most
            if key:
                _COUNTS[key] = {t: counts.get(t, 0) for t in DIMS}
            for t in DIMS:
                self._fits.setdefault(t, counts.get(t, 0) <= self.broadcast_rows)
        return self._fits[table]

    def narrowed(self, **frames) -> "Star":
        """Same star with some tables replaced by subsets of themselves. A table proven small
        stays proven; one that was too big is counted again, since its subset (one region's
        accounts, one account name) may well be small."""
        return replace(self, _fits={k: v for k, v in self._fits.items() if v}, _memo={}, place=None,
                       **frames)

    def in_years(self, years: Iterable[int]) -> "Star":
        """Same star with the orders of these calendar years only, for any analysis of orders: half-open
        ranges of the order time, and of the year partitions where they are stored."""
        from meridian.functions.exprs import in_years

        years = sorted(set(years))
        out = self.with_orders(lambda df: df.filter(in_years(df, "occurred_at", years)))
        return out if self.order_states is None else replace(out, order_states=self.order_states.filter(F.col(ORDER_YEAR).isin(years)))

    def with_orders(self, narrow: Callable[[DataFrame], DataFrame]) -> "Star":
        """Same star with some of its orders, with and without the product split."""
        return self.narrowed(orders=narrow(self.orders),
                             orders_detail=None if self.orders_detail is None else narrow(self.orders_detail))

    def cache_dimensions(self) -> "Star":
        """Star whose dimension tables proven small are persisted (memory, spilling to disk),
        for a session that runs many analyses on one star, as a dashboard does on every view.
        Facts are never cached; a lost cached block is recomputed from lineage."""
        frames = {t: getattr(self, t).persist(StorageLevel.MEMORY_AND_DISK)
                  for t in DIMS if self.fits(t)}
        return self.narrowed(**frames)

    def unpersist(self) -> None:
        for t in DIMS:
            getattr(self, t).unpersist()

    # ---- sink ----------------------------------------------------------------------------

    def write_tables(self, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                     clustered: bool = False) -> None:
        """Write the five tables under ``path`` in the layout :meth:`from_tables` reads.

        Orders (with their product split) are partitioned by ``order_year``, so a year filter
        prunes whole directories. Each task sorts its rows by year before writing, so it writes
        one file per year it holds: no shuffle, and no task receives a whole (possibly huge)
        year. Inside a file rows are in order of time, so a range of days skips row groups.

        ``clustered`` shuffles orders by ranges of (year, time) first: as many files as shuffle
        partitions, instead of one per task and year, and a year of any size is split."""
        for name in ("region", "sales_reps", "accounts", "web_events"):
            getattr(self, name).write.format(fmt).mode(mode).save(f"{path}/{name}.{fmt}")
        orders = self.detailed_orders.drop(ORDER_YEAR).withColumn(
            ORDER_YEAR, F.year("occurred_at"))
        if clustered:
            orders = orders.repartitionByRange(ORDER_YEAR, "occurred_at", "id")
        (orders.sortWithinPartitions(ORDER_YEAR, "occurred_at").write.format(fmt).mode(mode)
         .partitionBy(ORDER_YEAR).save(f"{path}/orders.{fmt}"))

    # ---- readers -------------------------------------------------------------------------

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str, fmt: str = "parquet", bad_rows: str = "leave", **kw) -> "Star":
        """Read ``region``, ``sales_reps``, ``accounts``, ``orders``, ``web_events`` under ``path``
        (one directory or file per table) with the fixed schemas. Orders written by
        :meth:`write_tables` come back with their ``order_year`` partition column. CSV rows that don't fit
        the schema are left out and listed by :meth:`rejected_rows`; ``bad_rows="fail"`` ends the read at one."""
        def read(name: str) -> DataFrame:
            if fmt == "csv":
                return _read_csv(spark, path, name, bad_rows).drop(CSV_TIME)
            reader = spark.read.schema(S.TABLES[name])
            return reader.format(fmt).load(f"{path}/{name}.{fmt}")

        orders = read("orders")
        return cls(read("region"), read("sales_reps"), read("accounts"), orders,
                   read("web_events"), orders_detail=orders, **{"place": tuple(f"{path}/{t}.{fmt}" for t in DIMS), **kw})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, **kw) -> "Star":
        """The five tables by name from the session catalog (``database.region`` ...), with
        their columns cast to the fixed schemas."""
        def read(name: str) -> DataFrame:
            df = spark.table(f"{database}.{name}" if database else name)
            types = dict(df.dtypes)
            cols = [F.col(f.name) if types[f.name] == f.dataType.simpleString()  # a cast blocks push-down
                    else F.col(f.name).cast(f.dataType).alias(f.name) for f in S.TABLES[name].fields]
            return df.select(*cols, *[c for c in (ORDER_YEAR,) if name == "orders" and c in df.columns])

        orders = read("orders")
        return cls(read("region"), read("sales_reps"), read("accounts"), orders,
                   read("web_events"), orders_detail=orders, **kw)

    @staticmethod
    def rejected_times(spark: SparkSession, path: str) -> DataFrame:
        """Orders of the CSV star under ``path`` whose time is given but can't be read: (id, text).
        The readers keep such orders with a NULL time; this reports them."""
        rows = _read_csv(spark, path, "orders")
        return rows.filter(F.col("occurred_at").isNull() & (F.trim(CSV_TIME) != "")).select("id", F.col(CSV_TIME).alias("text"))

    @staticmethod
    def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
        """(table, text) of the rows of the CSV star under ``path`` that don't fit their table's schema."""
        found = None
        for name in S.TABLES:
            rows = _csv_rows(spark, path, name)
            rows = rows.filter(F.col(CSV_ROW).isNotNull() & (_length(rows) >= 0))  # all columns are checked
            rows = rows.select(F.lit(name).alias("table"), F.col(CSV_ROW).alias("text"))
            found = rows if found is None else found.unionAll(rows)
        return found

    def register_views(self, prefix: str = "") -> None:
        """Temporary views ``{prefix}region`` ... ``{prefix}web_events`` (orders with their
        product split), so existing SQL over these names runs on Spark unchanged."""
        for name in ("region", "sales_reps", "accounts", "web_events"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")
        self.detailed_orders.createOrReplaceTempView(f"{prefix}orders")

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **kw) -> "Star":
        return cls.from_tables(spark, path, fmt="csv", **kw)

    @classmethod
    def from_frames(cls, region: DataFrame, sales_reps: DataFrame, accounts: DataFrame,
                    orders: DataFrame, web_events: DataFrame, **kw) -> "Star":
        return cls(region, sales_reps, accounts, orders, web_events, orders_detail=orders, **kw)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Star":
        """Map the driver's TPC-H-shaped tables onto the star.

        region <- region, sales_reps <- nation, accounts <- customer (website = lower(name),
        primary_poc = market segment), orders <- orders (total_amt_usd = o_totalprice),
        web_events <- events (channel = event_type). The product split comes from line items
        summed per order by return flag: A standard, N gloss, R poster; orders without lines
        get zeros, and ``total`` is the sum of the three quantities.
        """
        def read(name: str) -> DataFrame:
            return spark.read.schema(S.TESTDATA[name]).parquet(f"{sf_dir}/{name}.parquet")  # no job for its footers

        region = read("region").select(F.col("r_regionkey").alias("id"),
                                       F.col("r_name").alias("name"))
        reps = read("nation").select(F.col("n_nationkey").alias("id"),
                                     F.col("n_name").alias("name"),
                                     F.col("n_regionkey").alias("region_id"))
        accounts = read("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.lower("c_name").alias("website"), F.col("c_mktsegment").alias("primary_poc"),
            F.col("c_nationkey").alias("sales_rep_id"))
        orders = read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"),
            F.col("o_orderdate").alias("occurred_at"),
            F.col("o_totalprice").cast(S.MONEY).alias("total_amt_usd"))
        events = read("events").select(F.col("event_id").alias("id"),
                                       F.col("user_id").alias("account_id"),
                                       F.col("event_type").alias("channel"))

        flags = dict(zip(PRODUCTS, ("A", "N", "R")))
        lines = read("lineitem")

        def detail_of(some: DataFrame, lines: DataFrame) -> DataFrame:
            split = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
                *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("long")
                  .alias(f"{p}_qty") for p, f in flags.items()],
                *[F.sum(F.when(F.col("l_returnflag") == f,
                               (F.col("l_extendedprice").cast(S.MONEY) * 100).cast("long")))
                  .alias(f"{p}_cents") for p, f in flags.items()])
            detail = some.join(split, "id", "left").select(
                "id", "account_id", "occurred_at",
                *[F.coalesce(f"{p}_qty", F.lit(0).cast("long")).alias(f"{p}_qty") for p in PRODUCTS],
                *[(F.coalesce(f"{p}_cents", F.lit(0).cast("long")).cast("decimal(20,0)") / 100)
                  .cast(S.MONEY).alias(f"{p}_amt_usd") for p in PRODUCTS],
                "total_amt_usd")
            return detail.withColumn(
                "total", F.col("standard_qty") + F.col("gloss_qty") + F.col("poster_qty"))

        def narrowed(some: DataFrame) -> DataFrame:
            # lines meet the ids that are left before they are summed
            return detail_of(some, lines.join(some.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi"))

        detail = detail_of(orders, lines)
        kw = {"detail_of": narrowed, "unique_orders": True, **kw}
        return cls(region, reps, accounts, orders, events, orders_detail=detail, **{"place": tuple(f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "customer")), **kw})
