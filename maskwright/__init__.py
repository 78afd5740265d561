"""Sensitive-text detection and masking as Spark DataFrame columns, joins and streams."""
