"""Entity and web-page scoring as PySpark DataFrame operators."""
