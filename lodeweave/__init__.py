"""A PySpark-native engine for string corpora: preparation, tokens, masked-token data, evaluation and reports."""
