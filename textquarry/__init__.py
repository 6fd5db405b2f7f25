"""Analytics over document collections with Spark DataFrames."""
