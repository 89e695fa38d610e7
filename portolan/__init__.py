"""A PySpark-native analytics engine: portable query operators, mirrors, history and data-quality tools."""
