"""Document grounding and corpus processing on Spark DataFrames."""
