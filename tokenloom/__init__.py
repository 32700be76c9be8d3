"""Part of tokenloom, a Spark-native engine for token-cluster analytics."""
