"""Sensitive-document analytics as Spark plans."""
