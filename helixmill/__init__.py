"""A PySpark-native engine for genomic-site tables; helixmill.llm holds training-data operators."""
