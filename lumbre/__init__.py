"""lumbre: retrieval, knowledge-graph, terminology and evaluation analytics as Spark DataFrame operators."""
