"""textloom: Spark-native curation of instruction and chat training data."""
