"""sievelight: evidence retrieval, compression and corpus preparation on PySpark DataFrames."""

__version__ = "0.1.0"
