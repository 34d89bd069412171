"""Audit of coding-agent tool calls and scans for sensitive data, as Spark jobs."""

from warden.operators import audit, commands, frames as mcp, mask, paths, queries, replay, rules, scan, taint

__all__ = ["audit", "commands", "mask", "mcp", "paths", "queries", "replay", "rules", "scan", "taint"]
