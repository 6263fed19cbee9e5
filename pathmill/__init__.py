"""Entity-relationship analytics over materialised join views, on Spark DataFrames."""
