"""Privacy-erasure analytics and training-data preparation on Spark."""
