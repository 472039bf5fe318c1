"""Machine-log analytics and failure prediction on Spark DataFrames."""
