"""Entity-level feature building and scoring on Spark DataFrames."""
