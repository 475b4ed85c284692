"""A PySpark-native analytics engine for hierarchical time-series, event and array data."""
