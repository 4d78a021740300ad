"""PySpark-native analytics for ensembles of electoral district plans."""
