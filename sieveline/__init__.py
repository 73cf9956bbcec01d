"""sieveline: near-duplicate, leakage and corpus analytics as PySpark plans."""
