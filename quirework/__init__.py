"""quirework: document-layout analytics on Spark DataFrames."""
