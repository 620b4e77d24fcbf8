"""serialloom: a Spark-first engine for libraries of serialised text."""
