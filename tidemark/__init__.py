"""Evidence analytics as PySpark DataFrame operators."""
