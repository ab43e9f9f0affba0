"""vellum: DataFrame operators for personal text archives, built on Spark SQL."""

__version__ = "0.1.0"
