"""Document-recognition analytics on PySpark DataFrames."""
