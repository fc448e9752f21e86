"""The same checks over unbounded tables, with Structured Streaming."""

from .metrics import windowed_metrics
from .sinks import ROCKSDB_PROVIDER, drain, suite_per_batch, use_rocksdb
from .stateful import deduplicate_batches, deduplicate_stream, threshold_batches, threshold_stream

__all__ = [
    "ROCKSDB_PROVIDER", "deduplicate_batches", "deduplicate_stream", "drain", "suite_per_batch", "threshold_batches", "threshold_stream",
    "use_rocksdb", "windowed_metrics",
]
