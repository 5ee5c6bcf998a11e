"""A PySpark-native engine for corpora of binary and text blobs."""
