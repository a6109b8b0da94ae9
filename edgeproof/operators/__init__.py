"""Strategy-validation operators: DataFrames in, DataFrames or aggregate columns out."""
