"""In-store behaviour analytics as Spark DataFrame operators."""
