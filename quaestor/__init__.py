"""quaestor: question-answering analytics on Spark DataFrames."""
