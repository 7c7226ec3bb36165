"""tidemark: a PySpark-native engine for timed evidence, requirements and scores."""
