"""forklore: analytics over forked repositories and their pull requests, on Spark.

Every operator takes DataFrames (or Columns) and returns them lazily; nothing is
collected to the driver except single-row loop counters in the iterative graph
operators.
"""

__version__ = "0.1.0"
