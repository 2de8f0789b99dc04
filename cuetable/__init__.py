"""Caption and edit-timeline analytics on Spark DataFrames."""
