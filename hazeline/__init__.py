"""Air-quality analytics and forecasting on Spark DataFrames."""
