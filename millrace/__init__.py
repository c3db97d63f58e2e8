"""Dataset operations for word analytics, histories, logs and result rendering on Spark.

Every operation takes DataFrames and explicit parameters and returns a DataFrame (or a Column).
Nothing is collected to the driver; callers decide when an action runs.
"""

__version__ = "0.1.0"
