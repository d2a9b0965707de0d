"""veilframe: privacy-preserving tabular analytics and training-data preparation on Spark DataFrames."""
