"""All registered queries; importing the modules fills the registry."""

from warden.plans import audit_queries, frame_queries, log_queries, path_queries, scan_queries, source_queries, step_queries, stream_queries, taint_queries  # noqa: F401
from warden.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
