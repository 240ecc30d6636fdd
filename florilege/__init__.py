"""Document freshness analytics and training-data operators, written for Spark DataFrames."""
