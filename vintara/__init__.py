"""Point-in-time portfolio research and corpus preparation on PySpark."""
