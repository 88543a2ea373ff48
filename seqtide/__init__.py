"""seqtide: high-utility regular sequential patterns and training-data operators on Spark DataFrames."""
