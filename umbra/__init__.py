"""Sun-aware pedestrian analytics and corpus preparation on Spark DataFrames."""
