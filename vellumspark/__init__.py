"""Spark-native extraction of text, structure and resources from ebook and document files."""
