"""Queries over the operators, each beside the SQL it is compared with."""
