"""envspark: Spark DataFrame operators for environmental sensor readings."""

__version__ = "0.1.0"
