"""Marts, views, dashboard cards and bundles composed from the operators."""
