"""PySpark-native analytics over document and knowledge-base corpora."""
