"""Set-based ingestion and run analytics on Spark DataFrames."""
