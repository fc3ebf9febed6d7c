"""A Spark-native engine for hybrid document retrieval, its evaluation, and training-data preparation."""
