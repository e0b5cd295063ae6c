"""Fixed schemas of the five star tables. Readers never infer types."""

from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

MONEY = DecimalType(18, 2)


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


REGION = _s(("id", IntegerType()), ("name", StringType()))

SALES_REPS = _s(("id", IntegerType()), ("name", StringType()), ("region_id", IntegerType()))

ACCOUNTS = _s(("id", LongType()), ("name", StringType()), ("website", StringType()),
              ("primary_poc", StringType()), ("sales_rep_id", IntegerType()))

ORDERS = _s(("id", LongType()), ("account_id", LongType()), ("occurred_at", TimestampNTZType()),
            ("standard_qty", LongType()), ("gloss_qty", LongType()), ("poster_qty", LongType()),
            ("total", LongType()),
            ("standard_amt_usd", MONEY), ("gloss_amt_usd", MONEY), ("poster_amt_usd", MONEY),
            ("total_amt_usd", MONEY))

WEB_EVENTS = _s(("id", LongType()), ("account_id", LongType()), ("channel", StringType()))

TABLES = {
    "region": REGION,
    "sales_reps": SALES_REPS,
    "accounts": ACCOUNTS,
    "orders": ORDERS,
    "web_events": WEB_EVENTS,
}

# The columns that the testdata adapter reads of the driver's tables.
TESTDATA = {
    "region": _s(("r_regionkey", IntegerType()), ("r_name", StringType())),
    "nation": _s(("n_nationkey", IntegerType()), ("n_name", StringType()), ("n_regionkey", IntegerType())),
    "customer": _s(("c_custkey", LongType()), ("c_name", StringType()), ("c_nationkey", IntegerType()),
                   ("c_mktsegment", StringType())),
    "orders": _s(("o_orderkey", LongType()), ("o_custkey", LongType()), ("o_totalprice", DoubleType()),
                 ("o_orderdate", TimestampNTZType())),
    "lineitem": _s(("l_orderkey", LongType()), ("l_quantity", DoubleType()), ("l_extendedprice", DoubleType()),
                   ("l_returnflag", StringType())),
    "events": _s(("event_id", LongType()), ("user_id", LongType()), ("event_type", StringType())),
}
