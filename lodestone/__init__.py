"""A PySpark-native engine for scholarly corpora and training-data pipelines."""
