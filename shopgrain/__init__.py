"""Customer and sales analytics for retail order tables, built on Spark DataFrames."""
