"""finlake: a Spark-native engine for multi-country financial data."""
