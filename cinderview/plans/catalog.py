"""All registered queries; importing the modules registers them."""

from . import batch_queries, failure_queries, log_queries, resource_queries  # noqa: F401
from . import eventlog_queries  # noqa: F401
from . import report_queries, source_queries, stage_queries, stream_queries  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
