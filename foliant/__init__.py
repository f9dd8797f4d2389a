"""Spark-native retrieval, curation and reporting over versioned technical documents."""
