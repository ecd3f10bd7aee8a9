"""annotara: annotation and entity-reference analytics as Spark DataFrame operators."""
