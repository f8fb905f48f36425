"""quarry: governed analytics, retrieval and corpus preparation on Spark DataFrames."""
