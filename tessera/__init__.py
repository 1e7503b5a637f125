"""Spark-native analytics for research-assistant data: costs, conversations, retrieval, citations, plan state, events."""
