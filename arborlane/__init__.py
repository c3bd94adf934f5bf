"""Spark-native preparation, training, scoring and analysis of tree ensembles over tables."""
