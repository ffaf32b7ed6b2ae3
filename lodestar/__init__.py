"""Record linkage and training-data preparation on Spark."""
