"""Where rows come from and go to: managed tables, views and registered DataFrames."""

from millrace.sources.catalog import Catalog

__all__ = ["Catalog"]
