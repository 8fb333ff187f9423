"""Block-level accessibility analytics as PySpark DataFrame operators."""
