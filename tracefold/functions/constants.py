"""Names, thresholds and word lists the results depend on."""

NS_PER_SECOND = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SECOND
BUCKET_SLACK_SECONDS = 1800
UNIT_SEPARATOR = "\x1f"

SOURCE_SERVICES = ("codex_cli_rs", "codex-app-server")
# Callers reading events written by another deployment pass its service name and prefix.
DERIVED_SERVICE = "tracefold"
FINDING_NAME_PREFIX = "tracefold:"

TURN_SPAN_NAMES = (
    "run_sampling_request", "session_task.turn", "turn/start", "turn/steer",
    "turn/interrupt", "handle_responses",
)
TRANSPORT_EVENTS = (
    "codex.api_request", "codex.api_response",
    "codex.websocket_request", "codex.websocket_response",
)
TRANSPORT_REQUEST_EVENTS = ("codex.api_request", "codex.websocket_request")
QUALITY_TOOLS = (
    "pytest", "ruff", "mypy", "npm", "pnpm", "yarn", "bun", "cargo", "go", "make",
)
MUTATION_TOOLS = ("apply_patch", "write_file", "edit_file", "create_file")
SHELL_TOOLS = ("exec", "exec_command", "shell", "bash")

DETECTORS = (
    "tool_failure", "repeated_attempt", "transport_instability", "sandbox_friction",
    "turn_correction", "quality_gate_bypass", "command_churn", "tool_loop",
    "token_outlier", "skill_adherence", "scope_recurrence",
)
DETECTOR_VERSION = 1
NORMALIZATION_VERSION = 1

VOLATILE_KEYS = ("timestamp", "request_id", "call_id", "trace_id", "span_id", "nonce")
TEMPORARY_ROOTS = ("/tmp", "/private/tmp", "/var/folders")
TIMESTAMP_PATTERN = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})"
)
UUID_PATTERN = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
)
DECIMAL_PATTERN = r"(?:0|[1-9][0-9]*)(?:\.[0-9]+)?"
UINT_PATTERN = r"(?:0|[1-9][0-9]*)"

SUBCOMMANDS = {
    "cargo": ("build", "check", "clippy", "fmt", "run", "test"),
    "docker": ("build", "compose", "cp", "exec", "inspect", "logs", "ps", "run"),
    "git": (
        "add", "apply", "checkout", "commit", "diff", "fetch", "log", "merge", "mv",
        "pull", "push", "rebase", "restore", "rm", "show", "status", "switch", "worktree",
    ),
    "npm": ("audit", "ci", "exec", "install", "run", "test"),
    "pnpm": ("add", "build", "exec", "install", "run", "test"),
    "ruff": ("check", "format", "rule", "version"),
    "yarn": ("add", "build", "install", "run", "test"),
}
VALUE_OPTIONS = {
    "git": (
        "-C", "-b", "-c", "-m", "--author", "--date", "--format", "--git-dir",
        "--message", "--pathspec-from-file", "--work-tree",
    ),
    "grep": ("-C", "-e", "-f", "--context", "--file", "--regexp"),
    "make": ("-C", "--directory", "-f", "--file"),
    "pytest": (
        "-k", "-m", "--confcutdir", "--deselect", "--ignore", "--maxfail",
        "--override-ini", "--rootdir",
    ),
    "rg": ("-C", "-e", "-g", "-f", "--context", "--glob", "--regexp"),
    "ruff": ("--config", "--output-file", "--output-format"),
    "sed": ("-e", "-f", "--expression", "--file"),
}

EVIDENCE_FIELDS = (
    "args", "arguments", "argv", "assistant_output", "diagnostic_code",
    "error_message", "outcome",
)
EVIDENCE_CHARACTER_LIMIT = 1_000_000
# ASCII forms of the four secret shapes; the first keeps its key name.
NAMED_SECRET_PATTERN = r"(?i)\b(api[_-]?key|token|password|secret)\b\s*[:=]\s*['\"]?([^\s'\"]+)"
BARE_SECRET_PATTERNS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bgh[oprsu]_[A-Za-z0-9]{20,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
)
QUOTED_KEY_SECRET_PATTERN = (
    r"(?i)\"(api[_-]?key|token|password|secret)\"\s*:\s*\"[^\"]+\""
)

LOCAL_ZONE = "Europe/London"
TREND_WINDOW_DAYS = 7
FRESH_LAG_MS = 3_900_000
LATE_LAG_MS = 7_200_000
OUTLIER_MIN_BASELINE = 20

OBSERVATION_EVENT = "introspection.observation.detected"
TREND_EVALUATED_EVENT = "introspection.trend.evaluated"
TREND_PROMOTED_EVENT = "introspection.trend.promoted"
PIPELINE_EVENT = "introspection.pipeline.snapshot"
ACTIVATION_EVENT = "introspection.analysis_generation.activated"
REVIEW_SESSION_EVENT = "introspection.review.session_changed"
REVIEW_ACTIVITY_EVENT = "introspection.review.activity_snapshot"
PROPOSAL_EVENT = "introspection.proposal.state_changed"
OPERATIONAL_SCOPE = "operational"
REVIEW_SCOPE = "review"
REVIEW_ACTIVITY_ENTITY = "review-activity"

# items per session, sessions per batch, items per batch, input and output characters
REVIEW_LIMITS = {
    "classification": (10, 4, 40, 24_000, 8_000),
    "proposal": (1, 8, 8, 48_000, 16_000),
}
REVIEW_SESSIONS_PER_BATCH = 12

PROPOSAL_TRANSITIONS = (
    ("pending", "approved"), ("pending", "rejected"), ("approved", "applying"),
    ("applying", "applied"), ("applying", "implementation_failed"),
)
TIER_LABELS = (
    "Established tools of a project first.",
    "New tools second.",
    "Bespoke scripts third.",
)
