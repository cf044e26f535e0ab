"""layerloom: a Spark-native engine that layers code and document collections into a queryable knowledge base."""
