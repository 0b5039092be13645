"""Developer-contribution analytics as Spark DataFrame operators."""
