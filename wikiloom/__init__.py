"""Spark-native retrieval and knowledge-base analytics."""
