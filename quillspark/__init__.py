"""Spark-native literature retrieval, evidence analytics and research-state audits."""
