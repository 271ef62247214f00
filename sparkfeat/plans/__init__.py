"""Composite feature plans on the loan-history tables."""
