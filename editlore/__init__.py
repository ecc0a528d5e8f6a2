"""Edit-history analytics for collaborative knowledge graphs, on Spark DataFrames."""
