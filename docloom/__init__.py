"""docloom: document preparation, retrieval and evaluation statistics as Spark DataFrame operators."""
