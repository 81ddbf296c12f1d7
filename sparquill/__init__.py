"""Declarative model queries that compile to Spark DataFrame plans."""
