"""Seeded random stars in the testdata's TPC-H shape, with NULLs, namesakes, dangling keys
and ties, for differential testing against the oracle."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

CHANNELS = ["click", "error", "purchase", "signup", "view", "other"]


def build(out_dir: str, seed: int, hot: bool = False) -> None:
    """``hot``: account 1 holds a third of all orders and events."""
    rng = random.Random(seed)
    maybe = lambda v, p=0.04: None if rng.random() < p else v

    regions = [(0, "AFRICA"), (1, "ASIA"), (2, "O'Hare"), (3, "EUROPE")]
    rep_names = [f"NATION_{i}" for i in (1, 2, 12, 17, 22, 5)]
    nations = [(i, rng.choice(rep_names), rng.randrange(5)) for i in range(10)]
    cust_names = [f"Customer#{i:09d}" for i in range(50, 80)]
    customers = [(i, maybe(rng.choice(cust_names), 0.03), maybe(rng.randrange(12), 0.05),
                  0.0, rng.choice(["BUILDING", "MACHINERY", "HOUSEHOLD"]))
                 for i in range(1, 41)]
    start = datetime(1994, 1, 1)
    orders, lines = [], []
    for oid in range(1, 401):
        cust = 1 if hot and oid % 3 == 0 else maybe(rng.randrange(1, 46), 0.02)
        day = start + timedelta(days=rng.randrange(9 * 365), seconds=rng.choice([0, 86399]))
        price = maybe(round(rng.uniform(500, 500000), 2), 0.03)
        orders.append((oid, cust, price, maybe(day, 0.03)))
        for ln in range(rng.randrange(5)):
            lines.append((oid, ln + 1, float(rng.randrange(0, 101)),
                          round(rng.uniform(1, 90000), 2), rng.choice("ANR")))
    events = [(i, 1 if hot and i % 3 == 0 else maybe(rng.randrange(1, 46), 0.03),
               maybe(rng.choice(CHANNELS), 0.03)) for i in range(1, 301)]

    def write(name, fields, rows):
        cols = list(zip(*rows))
        pq.write_table(pa.table({n: pa.array(c, type=t) for (n, t), c in zip(fields, cols)}),
                       f"{out_dir}/{name}.parquet")

    write("region", [("r_regionkey", pa.int32()), ("r_name", pa.string())], regions)
    write("nation", [("n_nationkey", pa.int32()), ("n_name", pa.string()),
                     ("n_regionkey", pa.int32())], nations)
    write("customer", [("c_custkey", pa.int64()), ("c_name", pa.string()),
                       ("c_nationkey", pa.int32()), ("c_acctbal", pa.float64()),
                       ("c_mktsegment", pa.string())], customers)
    write("orders", [("o_orderkey", pa.int64()), ("o_custkey", pa.int64()),
                     ("o_totalprice", pa.float64()), ("o_orderdate", pa.timestamp("us"))], orders)
    write("lineitem", [("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()),
                       ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()),
                       ("l_returnflag", pa.string())], lines)
    write("events", [("event_id", pa.int64()), ("user_id", pa.int64()),
                     ("event_type", pa.string())], events)
    for name in ("supplier", "part"):
        write(name, [("k", pa.int64())], [(1,)])
