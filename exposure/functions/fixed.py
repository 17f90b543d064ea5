"""Fixed values of the detector: word lists, patterns and thresholds.

These decide what counts as a hit, so they are stated literally. Patterns are Java regular
expressions; each repeat is possessive or bounded so that no input makes them backtrack widely.
"""

# Tiers of a finding, strongest first, with their rank.
CERTAIN, LIKELY, POSSIBLE, NONE = "certain", "likely", "possible", "none"
TIER_RANK = {CERTAIN: 0, LIKELY: 1, POSSIBLE: 2}
RANK_TIER = {rank: tier for tier, rank in TIER_RANK.items()}

# Gate name -> weakest tier rank that it counts.
GATES = {"certain": 0, "high": 1, "paranoid": 2}

# Reason codes.
UUID = "uuid"
FLAG_FORM = "flag-form"
FUNCTION_CALL = "function-call"
TYPE_ANNOTATION = "type-annotation"
PASSPHRASE = "word-shaped-passphrase"
IDENTIFIER = "identifier"
LOW_TRANSITION = "low-transition"
UNCONFIRMED_MCP = "unconfirmed-mcp-shape"

# Reasons a name in a text can carry.
NAME_REASONS = (UUID, FLAG_FORM, PASSPHRASE, IDENTIFIER, LOW_TRANSITION)

# Labels of the summary line, in print order.
REASON_LABELS = {
    IDENTIFIER: "identifier",
    PASSPHRASE: "passphrase",
    LOW_TRANSITION: "low-transition",
    UUID: "uuid",
    UNCONFIRMED_MCP: "unconfirmed-mcp-shape",
}

# Value thresholds.
MIN_VALUE_LENGTH = 8
MIN_ENTROPY = 3.0
MIN_TRANSITION = 0.50
MIN_HEX_LENGTH = 16
MIN_VOWEL_SEGMENTS = 2
MAX_NAME_PREFIX = 256

# Vendor prefixes in the order in which they are reported: kind, literal(s) that every match
# contains, pattern.
VENDOR_PREFIXES = (
    ("Anthropic-style key", ("sk-ant-",), r"\bsk-ant-[A-Za-z0-9_-]{20,}\b"),
    ("OpenAI-style key", ("sk-",), r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("AWS access key id", ("AKIA",), r"\bAKIA[0-9A-Z]{16}\b"),
    ("GitHub fine-grained PAT", ("github_pat_",), r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("GitHub PAT", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b"),
    ("GitLab PAT", ("glpat-",), r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("Slack token", ("xox",), r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b"),
    ("Google API key", ("AIza",), r"\bAIza[0-9A-Za-z_-]{20,}\b"),
    ("Stripe secret key", ("sk_live_",), r"\bsk_live_[A-Za-z0-9]{20,}\b"),
    ("Stripe restricted key", ("rk_live_",), r"\brk_live_[A-Za-z0-9]{20,}\b"),
    ("npm token", ("npm_",), r"\bnpm_[A-Za-z0-9]{20,}\b"),
)

# Secret-name vocabulary, and lower-case literals of which every match contains one.
KEYWORD = r"(?:api[_-]?key|token|secret|password|passwd|private[_-]?key)"
KEYWORD_LITERALS = (
    "token", "secret", "passw",
    "apikey", "api_key", "api-key",
    "privatekey", "private_key", "private-key",
)

# White space as Python's str methods and regular expressions see it.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Everything but white space and quotes, common ranges first: what an assigned value is made of.
VALUE_CHARS = (
    r"[!#-&(-~\x7f-\x84\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e"
    r"\u2060-\u2fff\u3001-\x{10ffff}\x00-\x08\x0e-\x1b]"
)

BEARER = r"(?i)\bBearer[" + SPACES + r"]+([A-Za-z0-9._\-+=/]{16,})"

# Values nobody means as a secret.
PLACEHOLDERS = (
    "test123", "test1234", "changeme", "change_me", "changethis", "password", "password123",
    "secret", "yourkey", "your_api_key", "your-api-key", "placeholder", "example", "dummy",
    "fake", "sample", "xxxxxxxx", "12345678",
)

# Character classes of the transition rate.
UPPER = r"\p{IsUppercase}"
LOWER = r"\p{IsLowercase}"
DIGIT = r"\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"

# Directories that a tree scan leaves out, and file suffixes that it skips.
EXCLUDED_DIRS = (
    "node_modules", ".venv", "venv", "__pycache__", ".git", "dist", "build", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "target", ".next", ".nuxt", "coverage", ".eggs", ".hg", ".svn",
)
EXCLUDED_DIR_SUFFIX = ".egg-info"
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".egg-info")

# Files whose content is scanned.
TEXT_SUFFIXES = (
    "", ".env", ".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".json", ".toml", ".yaml", ".yml",
    ".ini", ".cfg", ".conf", ".config", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".txt", ".md",
    ".properties", ".xml", ".rb", ".go", ".rs", ".java", ".kt", ".php", ".cs",
)
TEXT_FILE_NAMES = ("Dockerfile", "Makefile", "Jenkinsfile")

# Files that are sensitive by name.
SSH_KEY_NAMES = ("id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")
MCP_NAMES = ("mcp.json", "claude_desktop_config.json")
HISTORY_NAMES = (
    ".bash_history", ".zsh_history", ".zhistory", ".python_history", ".node_repl_history", ".lesshst",
)
GIT_CONFIG_NAMES = (".gitconfig", ".git-credentials")
MCP_KEYS = ("mcpServers", "servers")

# Places under a home folder that a deep scan looks at.
HOME_CANDIDATES = (
    ".env", ".env.local", ".npmrc", ".pypirc", ".gitconfig", ".git-credentials", ".bash_history",
    ".zsh_history", ".zhistory", ".python_history", ".node_repl_history",
    ".ssh/id_rsa", ".ssh/id_ed25519", ".ssh/id_ecdsa", ".ssh/id_dsa",
    ".cursor/mcp.json", ".claude/mcp.json", ".config/claude/claude_desktop_config.json",
    ".config/Cursor/User/mcp.json",
)
APPDATA_CANDIDATES = (
    "Claude/claude_desktop_config.json", "Cursor/User/mcp.json",
    "Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history.txt",
)

# Agent transcripts: a folder under home, and the shape of the paths inside it.
TRANSCRIPT_LAYOUTS = (
    (".claude/projects", r"(?:.*/)?[^/]*\.jsonl"),
    (".codex/sessions", r"(?:.*/)?rollout-[^/]*\.jsonl"),
    (".codex/archived_sessions", r"(?:.*/)?rollout-[^/]*\.jsonl"),
    (".copilot/session-state", r"[^/]+/events\.jsonl"),
)
MAX_TRANSCRIPT_BYTES = 100 * 1024 * 1024
FILE_CONTENT_BYTES = 256_000
BINARY_PROBE_BYTES = 4096
LINES_SHOWN = 20

# Audit vocabulary.
AUDIT_ROUTES = ("inline", "spawned-console", "guard-session")
AUDIT_RESULTS = ("allowed", "denied", "timeout", "warn")

# Role matrix.
ROLES = ("admin", "writer", "runner")
WRITER_DENIED = ("member_add", "member_remove", "member_set_role", "passwd")
RUNNER_ALLOWED = ("run", "list", "status", "unlock", "lock")

# Process lineage.
MAX_CHAIN = 32
MAX_OFFERED = 8
FLOOR_LEVELS = 2
MIN_PID = 1

# Access sessions.
SESSION_MINUTES = 30
PRE_ADMIT_SECONDS = 900
VALUE_VERBS = ("get-value", "reveal", "get", "copy")

# Command policy: verb, nested verb or option, effect. The tool's own name is a parameter.
POLICY_RULES = (
    ("run", None, "wrap"), ("list", None, "allow"), ("status", None, "allow"),
    ("connect", None, "allow"), ("check", None, "allow"), ("scan", None, "allow"),
    ("lock", None, "allow"), ("docs", None, "allow"), ("--version", None, "allow"),
    ("--help", None, "allow"), ("config", "show", "allow"), ("identity", "show", "allow"),
    ("member", "list", "allow"),
    ("set", None, "deny"), ("remove", None, "deny"), ("import", None, "deny"),
    ("passwd", None, "deny"), ("change-password", None, "deny"), ("init", None, "deny"),
    ("unlock", None, "deny"), ("grant", None, "deny"), ("revoke", None, "deny"),
    ("setup", None, "deny"), ("reveal", None, "deny"), ("export", None, "deny"),
    ("copy", None, "deny"), ("_prompt-helper", None, "deny"), ("config", "set", "deny"),
    ("identity", "create", "deny"), ("member", "add", "deny"), ("member", "remove", "deny"),
    ("scan", "--yes", "deny"),
)
SHELL_NAMES = ("sh", "bash", "zsh", "dash", "busybox")
CHAIN_OPERATORS = ("&&", "||", ";", "|", "|&", "&")
