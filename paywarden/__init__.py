"""Payment-risk analytics expressed as Spark DataFrame, SQL, MLlib and streaming jobs."""
