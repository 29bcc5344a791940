"""spanlight: trace analytics and corpus processing on Spark DataFrames."""
