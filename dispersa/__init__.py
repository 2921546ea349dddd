"""Representative-subset analytics and corpus preparation on Spark DataFrames."""
