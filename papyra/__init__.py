"""Analytics over document collections and the links between them, on Spark DataFrames."""
