"""turnmill: a PySpark-native engine for nested multi-agent conversation data."""
