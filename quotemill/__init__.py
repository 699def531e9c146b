"""Table and stream operators for tick-level market data, written as Spark DataFrame transformations."""
