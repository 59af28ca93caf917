"""demandlake: Spark-native hourly demand analytics and forecasting operators."""

__version__ = "0.1.0"
