"""Document-corpus analytics as lazy Spark DataFrame operators."""
