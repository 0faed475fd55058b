"""tallyloom: basket analytics and table repair on Spark DataFrames."""
