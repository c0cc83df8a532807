"""A PySpark-native engine for building fine-tuning datasets."""
