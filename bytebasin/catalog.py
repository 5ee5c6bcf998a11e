"""All queries of the library by name, with their equivalents in SQL."""

from bytebasin.plans import batch_queries, blob_queries, file_queries, layout_queries, metric_queries, region_queries, split_queries, store_queries, stream_queries  # noqa: F401
from bytebasin.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
