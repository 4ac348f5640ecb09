"""Spark-native analytics over application-metadata catalogues."""
