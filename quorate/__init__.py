"""Rating and agreement analytics over documents, declared as Spark DataFrames."""
