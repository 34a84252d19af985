"""Analytics over typed text memories, as PySpark DataFrames."""
