"""Spark-native document search, faceted analytics and (in ``llm``) training-data operators."""
