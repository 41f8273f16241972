"""wakeline: behaviour-sequence analytics as PySpark DataFrame plans."""
