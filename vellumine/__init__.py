"""vellumine: a PySpark-native analytics engine for archives of schemaless JSON records."""
