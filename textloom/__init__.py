"""A PySpark-native engine that turns raw text tables into training corpora."""
