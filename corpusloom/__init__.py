"""Spark-native analytics over document corpora: chunking, auditing, retrieval, graphs and question answering."""
