"""A PySpark-native engine for record pipelines, text retrieval and text analysis."""
