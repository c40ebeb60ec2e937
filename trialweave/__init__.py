"""Trial-log analytics as PySpark DataFrame operators."""
