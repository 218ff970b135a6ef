"""Part of forerun, the Spark-native lead-lag analytics engine."""
