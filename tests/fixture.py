"""Hand-made edge fixture in the testdata's TPC-H shape (region, nation, customer, orders,
lineitem, events), covering what the generated testdata lacks. Built from rows here; nothing
is read from elsewhere."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

# region: ASIA is the registry's scope; a region name with a quote; a region without reps.
REGIONS = [(0, "AFRICA"), (1, "ASIA"), (2, "O'Hare"), (3, "EMPTY")]

# nation = sales reps. NATION_12 exists in two regions (namesakes); NATION_22 has no
# accounts; NATION_8 points at a region that does not exist.
NATIONS = [(10, "NATION_10", 1), (12, "NATION_12", 1), (22, "NATION_22", 1),
           (5, "NATION_5", 0), (6, "NATION_12", 0), (7, "NATION_7", 2), (8, "NATION_8", 9)]

T = datetime


def _customers():
    rows = []
    # 1..13: ASIA accounts with 8..21 orders (threshold counts) and rank ties
    counts = {1: 21, 2: 20, 3: 16, 13: 16, 4: 15, 5: 11, 6: 10, 7: 9, 8: 8, 9: 8, 10: 8,
              11: 3, 12: 3}
    for k in counts:
        rows.append((k, f"Customer#{k:09d}", 10 if k % 2 else 12))
    rows += [
        (20, "Customer#000000020", 5),      # AFRICA, no orders (orderless account)
        (21, "Customer#dup", 5),            # namesakes
        (22, "Customer#dup", 6),
        (23, "Customer#000000023", None),   # no rep
        (24, "Customer#000000024", 7),      # O'Hare
        (29, "Customer#000000029", 7),      # O'Hare, no orders: NULL spend ranks 2nd there
        (25, "Customer#000000025", 8),      # rep without region
        (26, "Customer#000000026", 10),     # single order
        (27, "Customer#000000027", 12),     # tied highest mean (with 28)
        (28, "Customer#000000028", 5),
        (55, "Customer#000000055", 10),     # best month target
        (30, "Customer#000000030", 12),     # gap quarters / years
        (31, "Customer#000000031", 10),     # retained cohort
        (32, "Customer#000000032", 10),     # lost cohort
    ]
    return rows, counts


def build(out_dir: str) -> None:
    customers, counts = _customers()
    orders, lines = [], []
    oid = [1000]

    def order(cust, ts, price, items=()):
        oid[0] += 1
        orders.append((oid[0], cust, price, ts))
        for n, (flag, qty, ext) in enumerate(items, 1):
            lines.append((oid[0], n, float(qty), float(ext), flag))
        return oid[0]

    for k, n in counts.items():
        for i in range(n):
            # spread over 1995..2001 incl. a year-end second
            ts = T(1995 + (i % 7), 1 + (i * 5) % 12, 1 + (i * 7) % 28)
            if i == 0:
                ts = T(1995, 12, 31, 23, 59, 59)
            items = [("A", 70 if i % 3 == 0 else 10, 500.25), ("N", 5, 100.10),
                     ("R", 55 if i % 4 == 0 else 1, 75.5)]
            order(k, ts, round(1000.0 + 37.13 * i + k, 2), items)
    # namesakes each with orders; no-rep, O'Hare, region-less rep
    for cust in (21, 22, 23, 24, 25):
        order(cust, T(1996, 3, 1), 2500.00, [("A", 80, 900.0), ("R", 60, 20.0)])
        order(cust, T(1997, 3, 1), 1500.50)
    order(26, T(1998, 6, 15), 777.77, [("N", 0, 0.0)])            # single order, zero quantity
    for cust in (27, 28):                                           # tied maximum mean
        order(cust, T(1999, 1, 1), 900000.00)
        order(cust, T(2000, 1, 1), 900000.00)
    for ts, g in [(T(1999, 2, 1), 10.0), (T(1999, 3, 1), 20.0), (T(1999, 11, 1), 5.0),
                  (T(2001, 1, 1), 40.0)]:                           # best month: Feb/Mar tie? no
        order(55, ts, 100.0, [("N", 3, g)])
    order(55, T(1999, 4, 1), 100.0, [("N", 3, 30.0)])              # the best month
    for ts, q in [(T(1996, 1, 10), 10), (T(1996, 7, 10), 4), (T(1996, 8, 10), 3),
                  (T(1998, 2, 10), 9)]:                              # gap quarter and gap year
        order(30, ts, 300.0, [("A", q, 10.0), ("N", 2 * q, 5.0), ("R", q + 1, 1.0)])
    order(31, T(1997, 5, 5), 50.0)
    order(31, T(1999, 5, 5), 60.0)                                   # retained
    order(32, T(1997, 6, 6), 70.0)                                   # lost
    order(999, T(1996, 2, 2), 123.45)                                # unknown account
    order(999, T(2001, 12, 31, 23, 59, 59), 54.32)

    channels = ["click", "error", "purchase", "signup", "view"]
    events = []
    for i, cust in enumerate([1, 1, 2, 3, 12, 21, 22, 23, 24, 25, 999, 999, 26, 1, 2]):
        events.append((i + 1, cust, channels[i % len(channels)]))
    events.append((100, 24, "other"))                                # channel outside the list

    def write(name, schema, rows):
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        table = pa.table({f.name: pa.array(c, type=f.type) for f, c in zip(schema, cols)})
        pq.write_table(table, f"{out_dir}/{name}.parquet")

    write("region", [pa.field("r_regionkey", pa.int32()), pa.field("r_name", pa.string())],
          REGIONS)
    write("nation", [pa.field("n_nationkey", pa.int32()), pa.field("n_name", pa.string()),
                     pa.field("n_regionkey", pa.int32())], NATIONS)
    segments = ["BUILDING", "MACHINERY"]
    write("customer", [pa.field("c_custkey", pa.int64()), pa.field("c_name", pa.string()),
                       pa.field("c_nationkey", pa.int32()), pa.field("c_acctbal", pa.float64()),
                       pa.field("c_mktsegment", pa.string())],
          [(k, n, r, 0.0, segments[k % 2]) for k, n, r in customers])
    write("orders", [pa.field("o_orderkey", pa.int64()), pa.field("o_custkey", pa.int64()),
                     pa.field("o_totalprice", pa.float64()),
                     pa.field("o_orderdate", pa.timestamp("us"))], orders)
    write("lineitem", [pa.field("l_orderkey", pa.int64()), pa.field("l_linenumber", pa.int32()),
                       pa.field("l_quantity", pa.float64()),
                       pa.field("l_extendedprice", pa.float64()),
                       pa.field("l_returnflag", pa.string())], lines)
    write("events", [pa.field("event_id", pa.int64()), pa.field("user_id", pa.int64()),
                     pa.field("event_type", pa.string())], events)
    for name in ("supplier", "part"):  # present in the testdata layout, unused here
        write(name, [pa.field("k", pa.int64())], [(1,)])
