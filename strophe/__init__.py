"""PySpark-native text analytics for line-structured corpora."""
