"""A Spark-native engine for network-structured scientific data: relational operators, factor graphs, Boolean networks."""
