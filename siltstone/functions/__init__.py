"""Column expressions and pandas UDFs."""
