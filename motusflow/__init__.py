"""motusflow: a Spark-native engine for wearable accelerometer data and activity recognition."""
