"""Customer spend analytics written as Spark DataFrame operators."""
