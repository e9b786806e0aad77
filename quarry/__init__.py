"""A Spark-native engine for retrieval-augmented question answering over large document collections."""
