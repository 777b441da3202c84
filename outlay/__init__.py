"""A PySpark-native analytics engine for public-spending data."""
