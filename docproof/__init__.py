"""docproof: Spark-native evidence analytics over document collections."""
