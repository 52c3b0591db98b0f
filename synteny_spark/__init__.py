"""Comparative gene-order analytics as Spark DataFrame plans."""
