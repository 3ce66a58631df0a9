"""A Spark-native privacy analytics engine: anonymization, utility, attacks and private record linkage."""
