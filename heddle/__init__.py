"""Corpus building, checking and analysis as Spark DataFrame operators."""
