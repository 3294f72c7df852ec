"""Frame-track and transcript analytics on Spark DataFrames."""
