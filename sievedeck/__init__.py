"""sievedeck: text retrieval, page analysis and near-duplicate analytics on Spark DataFrames."""
