"""Freight-network analytics and corpus preparation on PySpark."""
