"""siftline: query-conditioned pruning of text observations, and their accounting, on Spark DataFrames."""
