"""Column expressions (money, exact rounding, date ranges, labels)."""
