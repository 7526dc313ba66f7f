"""Fixed values of the data model: states, roles, defaults and error classes."""

# --- fixed values ---------------------------------------------------------
DEFAULT_MAX_PAGES = 500
DEFAULT_START_PAGE = 1
DEFAULT_RECORDS_PATH = "results"
DEFAULT_TIMEOUT_SECONDS = 30
TIMEOUT_CEILING_SECONDS = 120
BODY_CEILING_BYTES = 10 * 1024 * 1024

DEFAULT_LOAD_BATCH = 500
IDENTIFIER_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"
DEFAULT_DESTINATION_SCHEMA = "dbo"

MAX_ATTEMPTS = 5
BACKOFF_BASE_SECONDS = 10
BACKOFF_CAP_SECONDS = 300
BACKOFF_JITTER = 0.25

MIGRATION_BATCH = 100
PROBLEM_SAMPLE = 200
STALE_AFTER_MINUTES = 15
RECENT_RUNS = 50

ERROR_TEXT_LENGTH = 1000
TRUNCATION_SUFFIX = "... [truncated]"
REDACTED = "[redacted]"
OMITTED_REDIRECT = "<redirect-target-omitted>"

RUN_STATUSES = ["pending", "running", "succeeded", "failed"]
TERMINAL_RUN_STATUSES = ["succeeded", "failed"]
JOB_STATUSES = [
    "pending", "running", "succeeded", "partially_failed", "failed", "cancelled",
]
ACTIVE_JOB_STATUSES = ["pending", "running"]

VIEW_ROLES = ["owner", "admin", "engineer", "analyst"]
CONTINUE_ROLES = ["owner", "admin", "engineer"]
MIGRATION_VIEW_ROLES = ["owner", "admin"]

ALLOWED_METHODS = ["GET", "POST"]

CONNECTORS = {"source": ["rest_api"], "destination": ["sqlserver"]}

# category -> retryable; None means the raiser decides.
ERROR_CLASSES = {
    "FetchFailed": None,
    "LoadFailed": None,
    "ConnectionTestFailed": None,
    "MalformedResponseError": False,
    "AuthenticationError": False,
    "UnsupportedCapability": False,
    "ConfigurationError": False,
    "MappingError": False,
    "SchemaMismatchError": False,
    "PageLimitExceededError": False,
    "OutboundRequestBlockedError": False,
    "RawPayloadAccessDenied": False,
    "RawPayloadIntegrityError": False,
    "RunClaimRejected": False,
    "InvalidRunTransition": False,
}
UNEXPECTED_ERROR = "UnexpectedError"
CONTINUABLE_ERROR = "PageLimitExceededError"
