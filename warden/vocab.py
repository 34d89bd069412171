"""Closed vocabularies and rule tables shared by every job.

Everything here is configuration: values that must equal the audited policy
contract, so that decisions of a replay agree with decisions taken live.
"""

# --- fixed values: enumerations, in contract order -------------------------
CAPABILITIES = (
    "file_read", "file_write", "file_delete", "file_move", "file_search", "shell_execute",
    "network_read", "network_write", "network_request", "mcp_call", "git_operation", "unknown",
)
READ_CAPABILITIES = ("file_read", "file_move", "file_search")
WRITE_CAPABILITIES = ("file_write", "file_delete", "file_move")
OPEN_CAPABILITIES = ("mcp_call", "unknown")

CATEGORIES = (
    "credential", "authentication", "personal_data", "financial_data", "customer_data",
    "private_content", "operational_sensitive", "unknown_sensitive",
)
CATEGORY_RANK = {
    "credential": 8, "authentication": 7, "financial_data": 6, "customer_data": 5,
    "personal_data": 4, "private_content": 3, "operational_sensitive": 2, "unknown_sensitive": 1,
}
EFFECT_RANK = {"allow": 0, "ask": 1, "deny": 2}
SEVERITIES = ("info", "low", "medium", "high", "critical")

KNOWN = {
    "agent": ("codex", "cursor", "opencode", "guarded_execution", "mcp_proxy"),
    "event": ("pre_tool_use",),
    "content_type": (
        "application/json", "text/plain", "text/markdown", "application/octet-stream",
    ),
}

# --- fixed values: keys recognised inside free-form tool input -------------
INPUT_KEYS = {
    "path": (
        "path", "paths", "file", "files", "file_path", "file_paths", "filepath", "filename",
        "target", "destination",
    ),
    "command": ("command", "cmd", "shell_command"),
    "query": ("query", "sql", "statement"),
}
DATABASE_TOOL_PARTS = ("__db__", "database", "sql", "postgres", "mongo")

# --- fixed values: built-in path rules -------------------------------------
# (rule id, category, reason, severity, operation, patterns)
BUILT_IN_RULES = (
    ("drupal.secret.env", "secrets", "Environment secret file.", "critical", "read",
     ("**/.env", "**/.env.*")),
    ("composer.secret.auth_json", "secrets", "Composer authentication file.", "critical", "read",
     ("**/auth.json", "**/composer-auth.json")),
    ("drupal.secret.settings_php", "secrets", "Site settings file.", "critical", "read",
     ("**/sites/*/settings.php", "**/sites/*/settings.local.php",
      "**/env/**/settings.php", "**/env/**/settings.local.php")),
    ("filesystem.secret.private_key", "secrets", "Private key material.", "critical", "read",
     ("**/*.pem", "**/*.key")),
    ("filesystem.secret.credential_store", "secrets", "Credential store.", "critical", "read",
     ("**/.ssh/id_rsa", "**/.ssh/id_dsa", "**/.ssh/id_ecdsa", "**/.ssh/id_ecdsa_sk",
      "**/.ssh/id_ed25519", "**/.ssh/id_ed25519_sk", "**/.aws/credentials",
      "**/.azure/accessTokens.json", "**/.azure/msal_token_cache.json",
      "**/.config/gcloud/credentials.db*",
      "**/.config/gcloud/application_default_credentials.json", "**/.kube/config",
      "**/.docker/config.json", "**/.netrc", "**/_netrc", "**/.npmrc", "**/.pypirc")),
    ("filesystem.write.core", "filesystem", "Managed core code.", "high", "write",
     ("**/web/core/**", "**/core/**")),
    ("filesystem.write.vendor", "filesystem", "Managed vendor code.", "high", "write",
     ("**/vendor/**",)),
    ("filesystem.write.contrib_module", "filesystem", "Managed contributed module.", "high",
     "write", ("**/web/modules/contrib/**",)),
    ("filesystem.write.contrib_theme", "filesystem", "Managed contributed theme.", "high",
     "write", ("**/web/themes/contrib/**",)),
)

# --- fixed values: sensitive table globs -----------------------------------
SENSITIVE_TABLES = (
    "sessions", "users", "users_field_data", "users_data", "user__*", "key_value",
    "key_value_expire", "comment", "comment_field_data", "comment__*", "webform_submission",
    "webform_submission_data", "webform_submission_log", "commerce_order", "commerce_order__*",
    "commerce_order_item", "commerce_order_item__*", "commerce_payment", "commerce_payment__*",
    "commerce_payment_method", "commerce_payment_method__*", "profile", "profile_field_data",
    "profile_revision", "profile_field_revision", "profile__*", "profile_revision__*",
    "commerce_shipment", "commerce_shipment__*", "watchdog", "flood",
)
UNPREFIXED_TABLES = ("comment", "profile", "watchdog", "flood")

SQL_MUTATIONS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "CREATE", "GRANT",
    "REVOKE",
)
SQL_FILE_WORDS = ("LOAD_FILE", "OUTFILE", "DUMPFILE")
SQL_READERS = ("SELECT", "SHOW", "EXPLAIN", "DESCRIBE")
SQL_SAFE_CALLS = (
    "COUNT", "SUM", "AVG", "MIN", "MAX", "COALESCE", "IFNULL", "NULLIF", "CONCAT", "LOWER",
    "UPPER", "LENGTH", "CHAR_LENGTH", "ROUND", "ABS", "DATE_FORMAT", "NOW", "CURRENT_TIMESTAMP",
    "CAST", "CONVERT", "JSON_EXTRACT", "SUBSTRING", "TRIM", "SELECT", "FROM", "IN", "EXISTS",
    "AS", "WHEN", "OVER",
)

# --- fixed values: taint categories of sources -----------------------------
PATH_SOURCE_CATEGORIES = {
    "drupal.secret.env": ("credential", "authentication"),
    "composer.secret.auth_json": ("credential", "authentication"),
    "filesystem.secret.private_key": ("credential", "authentication"),
    "filesystem.secret.credential_store": ("credential", "authentication"),
    "drupal.secret.settings_php": ("credential", "authentication", "operational_sensitive"),
}
# (words a table name may start with once its prefix is removed, categories)
TABLE_SOURCE_CATEGORIES = (
    (("sessions", "flood", "users", "user__"), ("credential", "authentication", "personal_data")),
    (("commerce_payment", "commerce_order", "commerce_shipment"),
     ("personal_data", "financial_data", "customer_data")),
    (("webform_submission", "comment", "profile"), ("personal_data", "customer_data")),
    (("watchdog", "key_value"), ("operational_sensitive",)),
)

# --- fixed values: sensitive field words -----------------------------------
# (category, words that may end a name, names matched whole)
FIELD_WORDS = (
    ("credential", ("password", "passwd", "secret", "api_key", "private_key"),
     ("pass", "token", "access_token", "refresh_token", "accountkey", "access_key_id",
      "secret_access_key")),
    ("authentication", ("authorization", "cookie", "session", "session_id", "hash"), ()),
    ("financial_data", ("card_number", "iban", "bank_account", "payment_method"), ()),
    ("customer_data", ("billing_address", "shipping_address", "customer_profile",
                       "webform_submission", "comment_author"), ()),
    ("personal_data", ("email", "mail", "phone", "telephone", "address", "postal_code",
                       "birth_date", "date_of_birth"), ()),
)
FIELD_DETECTORS = {
    "credential": "structured.credential_field",
    "authentication": "structured.authentication_field",
    "financial_data": "structured.financial_field",
    "customer_data": "structured.customer_field",
    "personal_data": "structured.personal_field",
}

# --- fixed values: provider tokens (prefix pattern, minimum total length) --
TOKEN_PREFIXES = {
    "secret.github_token": (("ghp_", 36), ("gho_", 36), ("ghu_", 36), ("ghs_", 36), ("ghr_", 36),
                            ("github_pat_", 24)),
    "secret.gitlab_token": (("glpat-", 20),),
    "secret.aws_access_key": (("AKIA", 20), ("ASIA", 20)),
    "secret.google_api_key": (("AIza", 39),),
    "secret.stripe_key": (("sk_live_", 20), ("rk_live_", 20), ("sk_test_", 20), ("rk_test_", 20)),
    "secret.slack_token": (("xoxb-", 20), ("xoxp-", 20), ("xoxa-", 20), ("xoxr-", 20)),
    "secret.oauth_token": (("ya29.", 20),),
}

# --- fixed values: limits ---------------------------------------------------
MAX_SCAN_BYTES = 1024 * 1024
MAX_FINDINGS = 256
MAX_NEWLINES = 16_384
MAX_LINE_DELIMITERS = 4_096
MAX_PATH_BYTES = 4_096
MAX_STRING_BYTES = 16 * 1024
MAX_IDENTIFIER_BYTES = 256
MAX_LIST = 128
MAX_SHELL_TOKENS = 512
MAX_SHELL_DEPTH = 4
MAX_WRAPPERS = 8
MAX_JSON_DEPTH = 16
MAX_FRAME_DEPTH = 32
MAX_SOURCES = 32
MAX_PENDING = 64
MAX_RULES = 1_024
MAX_PATTERNS = 256

PROGRAM_SINKS = {
    "outbound_http": ("curl", "wget", "http", "https", "httpie", "xh"),
    "remote_shell": ("ssh",),
    "remote_file_transfer": ("scp", "sftp"),
    "api_submission": ("gh", "aws", "gcloud", "az"),
    "outbound_network": ("nc", "netcat", "socat"),
    "messaging": ("mail", "mailx", "sendmail"),
}

# --- fixed values: frame protocol ------------------------------------------
DATA_METHODS = ("tools/call", "resources/read", "prompts/get", "completion/complete")
CLIENT_NOTIFICATIONS = ("notifications/initialized", "notifications/cancelled")
CLIENT_METHODS = DATA_METHODS + CLIENT_NOTIFICATIONS + (
    "initialize", "ping", "tools/list", "resources/list", "resources/templates/list",
    "prompts/list", "logging/setLevel",
)
SERVER_NOTIFICATIONS = (
    "notifications/progress", "notifications/message", "notifications/tools/list_changed",
    "notifications/resources/list_changed", "notifications/prompts/list_changed",
)


def placeholder(category: str) -> str:
    """Text that replaces a value of ``category``."""
    return f"[REDACTED:{category.upper()}]"
