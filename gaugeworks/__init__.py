"""Measurement analytics on Spark: reusable DataFrame operators and Column functions."""
