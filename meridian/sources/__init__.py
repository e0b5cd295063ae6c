"""Readers for the five star tables (CSV, Parquet, the driver's TPC-H-shaped testdata)."""
