"""Request, retrieval and reliability analytics as PySpark DataFrame operators."""
