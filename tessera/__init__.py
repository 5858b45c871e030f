"""tessera: a Spark-native engine for versioned knowledge corpora."""
