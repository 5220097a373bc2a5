"""Strataloom: document analytics, permission-aware search and audit analytics as PySpark DataFrame programs."""
