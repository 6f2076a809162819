"""Imports every module that registers queries."""

from registry import dashboard, ingest, marts, predict, quality, search, streams  # noqa: F401
