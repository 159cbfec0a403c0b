"""kausal: constraint-based causal structure discovery on Spark DataFrames."""
