"""tidelake: Spark-native trace, interval, quality and selection analytics."""
