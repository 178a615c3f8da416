"""quarry: a Spark-native engine for document corpora and retrieval experiments."""
