"""Tool identity and input candidates (P1-P5, P25 for tools)."""

from __future__ import annotations

from warden.functions import sql as F
from warden.functions.sql import Sql
from warden.functions.variants import nodes, texts_under
from warden.vocab import DATABASE_TOOL_PARTS, INPUT_KEYS, MAX_JSON_DEPTH

# --- fixed values: tool names of the three agents ---------------------------
CODEX_TOOLS = {
    "file_read": ("read", "read_file", "read_text_file", "get_file"),
    "file_write": ("write", "write_file", "write_text_file", "create_file", "edit_file"),
    "file_delete": ("delete", "delete_file", "remove_file"),
}
CURSOR_TOOLS = {
    "shell_execute": ("shell",), "file_read": ("read",), "file_write": ("write", "edit"),
    "file_delete": ("delete",),
}
OPENCODE_TOOLS = {
    "shell_execute": ("bash",), "file_read": ("read",), "file_write": ("write", "edit", "apply_patch"),
    "network_read": ("webfetch", "websearch"),
}


def _lookup(name: Sql, tools: dict) -> F.When:
    ladder = None
    for kind, names in tools.items():
        ladder = F.when(name.isin(*names), kind) if ladder is None else ladder.when(name.isin(*names), kind)
    return ladder


def capability(agent: Sql, tool: Sql) -> Sql:
    """Capability of a native tool name."""
    low = F.lower(tool)
    last = F.substring_index(low, "__", -1)
    codex = F.when(tool == "Bash", "shell_execute").when(tool == "apply_patch", "file_write").otherwise(
        _lookup(last, CODEX_TOOLS).when(low.startswith("mcp__"), "mcp_call").otherwise("unknown"))
    cursor = _lookup(low, CURSOR_TOOLS).when(low.startswith("mcp:"), "mcp_call").otherwise("unknown")
    opencode = _lookup(low, OPENCODE_TOOLS).otherwise("unknown")
    return F.when(agent == "codex", codex).when(agent == "cursor", cursor).when(
        agent == "opencode", opencode).otherwise("unknown")


def is_mcp(tool: Sql, kind: Sql) -> Sql:
    """The transport survives a mapping onto file capabilities."""
    low = F.lower(tool)
    return (kind == "mcp_call") | low.startswith("mcp__") | low.startswith("mcp:")


def candidates(value: Sql, kind: str, depth: int = MAX_JSON_DEPTH) -> Sql:
    """Strings under the keys of one kind anywhere in the input (a VARIANT)."""
    return texts_under(value, INPUT_KEYS[kind], depth)


def query_not_text(value: Sql, depth: int = MAX_JSON_DEPTH) -> Sql:
    """A query key that holds something other than text makes the call invalid.

    Leaves keep their key through arrays, so a number or null directly under a
    query key shows as a leaf; an object there shows in the path of its leaves.
    """
    words = "|".join(INPUT_KEYS["query"])
    return F.exists(nodes(value, depth), lambda n: (
        F.lower(n["key"]).isin(*INPUT_KEYS["query"]) & (F.schema_of_variant(n["value"]) != "STRING"))
        | n["path"].rlike(rf"(?i)/(?:{words})(?:\[\])*/"))


def patch_paths(text: Sql) -> Sql:
    """P5: files a patch adds, updates, deletes or moves."""
    found = F.regexp_extract_all(text, r"(?dm)^\*\*\* (?:Add File|Update File|Delete File|Move to): ([^\n]*)", 1)
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")), lambda p: p != "")


def database_tool(tool: Sql) -> Sql:
    """A tool whose name says database: without a query it cannot be inspected."""
    low = F.lower(tool)
    return F.any_of(low, DATABASE_TOOL_PARTS)


def tool_sink(tool: Sql, kind: Sql, has_urls: Sql) -> Sql:
    """P25, the part that needs no command."""
    low = F.lower(tool)
    unknown = kind == "unknown"
    return (
        F.when(is_mcp(tool, kind), "outbound_mcp")
        .when(kind.isin("network_write", "network_request"), "outbound_network")
        .when((kind == "network_read") & has_urls, "outbound_http")
        .when(unknown & F.contains(low, "mcp"), "outbound_mcp")
        .when(unknown & low.rlike("upload|browser"), "browser_upload")
        .when(unknown & low.rlike("slack|email|message"), "messaging")
        .when(unknown & low.rlike("issue|ticket|linear|github|gitlab"), "api_submission")
        .when(unknown & low.rlike("http|fetch|request"), "outbound_http")
    )
