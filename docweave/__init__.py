"""docweave: document-graph checking and querying on Spark DataFrames."""
