"""Statistical analytics on PySpark DataFrames."""
