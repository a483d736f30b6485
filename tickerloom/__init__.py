"""Equity analytics as Spark DataFrame operators."""
