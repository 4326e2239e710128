"""geotab: structural-geology data as Spark DataFrames."""
