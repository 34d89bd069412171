"""All readers and writers in one place."""

from warden.operators.frames import read_frames
from warden.sources.audit_lake import read_audit, write_audit
from warden.sources.calls import read_calls, read_results, split_valid
from warden.sources.corpus import read_corpus

__all__ = ["read_audit", "read_calls", "read_corpus", "read_frames", "read_results", "split_valid", "write_audit"]
