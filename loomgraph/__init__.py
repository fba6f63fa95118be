"""PySpark-native retrieval engine over hypergraphs, and training-data operators."""
