"""A PySpark-native engine for text corpora, evaluation tables and embedding or weight statistics."""
