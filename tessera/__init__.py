"""tessera: a Spark-first analytics engine for text corpora and their embeddings."""
