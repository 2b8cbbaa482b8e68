"""Sources and sinks: alias catalog reads, feature catalogs, metric table writes."""

from foldwise.sources.catalog import Catalog, feature_catalog, union_catalogs
from foldwise.sources.sink import write_table, write_and_read

__all__ = ["Catalog", "feature_catalog", "union_catalogs", "write_table", "write_and_read"]
