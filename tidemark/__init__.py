"""tidemark: marketplace price indexes, history and data quality as Spark jobs."""

__version__ = "0.1.0"
