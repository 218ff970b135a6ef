"""forerun: which market venue moves first, measured with Spark DataFrames."""
