"""clipquery: a PySpark-native engine for retrieval and question answering over time-stamped media."""
