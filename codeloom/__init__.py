"""codeloom: a Spark-native code-intelligence and text-corpus analytics engine."""
