"""lexloom: regulation-text and rule analytics as PySpark DataFrame jobs."""
