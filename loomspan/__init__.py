"""loomspan: interval, variation-graph and genotype analytics as Spark DataFrames."""
