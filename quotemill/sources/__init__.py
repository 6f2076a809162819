"""Schemas, table readers, feed parsers and write semantics."""
