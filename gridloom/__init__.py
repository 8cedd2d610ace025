"""Spark-native engine for documents, the tables inside them and their verification.

Every operator takes and returns DataFrames.  The subpackage ``llm`` holds the operators on
training text; nothing else in the package imports it.
"""
