"""Spark-native structure and relevance analytics over corpora of files, documents and links."""
