"""weft: analytics operators written as Spark DataFrame, SQL and streaming code."""
