"""Build the region dashboard's datasets from a stored star.

    python -m meridian --tables PATH [--format parquet|csv] [--region NAME] [--out DIR]
                       [--channels a,b,c] [--years y,y] [--order-years y,y] [--states PATH] [--master URL]

Reads the five tables under PATH (``Star.from_tables``), builds every dashboard dataset for
the region (all regions when omitted) and writes each one under DIR/<name> as Parquet; without
``--out`` it prints the first rows of each. With ``--states`` the orders' roll-up is kept under that path: years
whose number of orders has changed since are brought up to date, and the datasets are served from it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from meridian.operators.dashboard import datasets
from meridian.plans import states
from meridian.session import get_session
from meridian.sources.star import Star


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="meridian", description=__doc__.splitlines()[0])
    ap.add_argument("--tables", required=True, help="directory holding the five tables")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--region", default=None, help="region name; all regions when omitted")
    ap.add_argument("--out", default=None, help="write each dataset as Parquet under this path")
    ap.add_argument("--channels", default=None,
                    help="comma-separated channel columns of the rep x channel matrix")
    ap.add_argument("--years", default=None, help="comma-separated years of the monthly sales")
    ap.add_argument("--order-years", default=None, help="comma-separated years that all order analyses are limited to")
    ap.add_argument("--states", default=None, help="path of the maintained roll-up of the orders; made when missing")
    ap.add_argument("--master", default=None, help="Spark master when not set by spark-submit")
    args = ap.parse_args(argv)

    # under spark-submit the cluster's session and settings are used as they are; local
    # defaults (shuffle partitions = cores, AQE, UI off) only with an explicit --master
    if args.master:
        spark = get_session(args.master)
    else:
        spark = SparkSession.builder.appName("meridian").getOrCreate()
    star = Star.from_tables(spark, args.tables, fmt=args.format)
    extra = {"channels": args.channels.split(",")} if args.channels else {}
    if args.years:
        extra["years"] = [int(y) for y in args.years.split(",")]
    if args.states:
        stored = spark._jvm.org.apache.hadoop.fs.Path(args.states)
        if stored.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stored):
            years = states.changed_years(star, args.states)
            if years:
                states.refresh_states(star, args.states, years)
        else:
            states.write_states(star, args.states)
        star = states.with_states(star, states.read_states(spark, args.states))
    if args.order_years:
        star = star.in_years(int(y) for y in args.order_years.split(","))
    made = datasets(star, args.region, **extra)
    for name, df in made.items():
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(f"== {name}")
            df.show(20, truncate=False)
    made.close()


if __name__ == "__main__":
    main()
