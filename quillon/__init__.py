"""quillon: a PySpark-native analytics engine for multi-site retail operations and training-data pipelines."""
