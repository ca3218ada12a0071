"""tapewise: trader analytics (returns, signals, backtests, behavior, copy accounting) on PySpark.

Every operator is a function from DataFrames to a DataFrame; nothing is collected on the driver.
"""

__version__ = "0.1.0"
