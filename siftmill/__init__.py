"""siftmill: retrieval, evaluation and log analytics as Spark DataFrame operators."""
