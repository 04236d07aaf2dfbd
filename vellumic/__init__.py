"""Spark-native analytics over competing machine readings of scanned documents."""
