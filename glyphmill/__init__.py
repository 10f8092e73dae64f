"""A Spark-native engine for line-oriented text datasets and their validation."""
