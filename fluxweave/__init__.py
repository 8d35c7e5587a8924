"""fluxweave: conservative field remapping on Spark DataFrames."""
