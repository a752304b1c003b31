"""millrace: corpus and event analytics expressed as Spark DataFrames."""
