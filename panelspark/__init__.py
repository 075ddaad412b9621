"""Panel analytics and factor research on Spark DataFrames."""
