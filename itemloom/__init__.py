"""Question-bank and corpus analytics as Spark DataFrame transformations."""
