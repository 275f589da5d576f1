"""Causal (strictly as-of) transfer-graph analytics as DataFrame and SQL plans."""
