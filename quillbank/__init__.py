"""Query-bank analytics on Spark: DataFrame operators over keyword, text, vector and citation-log tables."""
