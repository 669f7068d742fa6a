"""foliomill: a Spark-native engine that turns report collections into analysis-ready tables."""
