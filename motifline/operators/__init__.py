"""Graph operators on DataFrames: candidates, expansion, matching, sharing, partitioning."""
