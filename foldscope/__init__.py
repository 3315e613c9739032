"""Detection-cohort analytics as Spark DataFrame operators."""
