"""folio: a Spark-native passage retrieval and evaluation engine."""
