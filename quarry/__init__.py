"""quarry: hybrid retrieval, guards, chunking and evaluation over text, as Spark DataFrames."""
