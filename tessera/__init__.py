"""tessera: a Spark-native warehouse, mining and corpus-preparation engine."""
