"""Spark-native analytics over price bars, keyed by instrument, parameter set, permutation and fold."""
