"""tapeworks: market-data analytics on Spark: indicators, risk, quality checks, streams and SQL over quotes."""
