"""Document-entity queries, ingestion and rendering on Spark DataFrames."""
