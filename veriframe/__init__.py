"""A Spark-native engine for image forensics and training-data preparation."""
