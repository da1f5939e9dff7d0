"""folioq: rule-driven content extraction and document analytics on Spark DataFrames."""
