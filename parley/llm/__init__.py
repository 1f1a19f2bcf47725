"""Operators for preparing training data at scale, each with a query over the given tables."""
