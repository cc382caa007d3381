"""Data-arrival and completeness analytics expressed as Spark DataFrame plans."""
