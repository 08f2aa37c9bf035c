"""PySpark-native document and content-pipeline analytics."""
