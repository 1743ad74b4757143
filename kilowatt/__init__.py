"""kilowatt: load forecasting and table analytics as Spark DataFrame /
``pyspark.ml`` jobs."""

__version__ = "0.1.0"
