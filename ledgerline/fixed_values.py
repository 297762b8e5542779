"""Fixed values. Results depend on them literally; they are stated once, here."""

# Object keys (folded) that hold a usage object.
USAGE_WRAPPERS = ["usage", "tokens", "tokenusage", "usagemetadata", "tokencounts", "tokencount", "tokenstats"]

# Folded keys that never carry token counts.
NOT_COUNTS = [
    "ok", "failed", "reward", "status", "type", "id", "name", "event", "kind", "scope", "level", "model", "error",
]

# A nested object is read as part of its parent when its folded key contains one of these.
LIFTED_WORDS = ["cache", "detail", "token", "usage", "ephemeral"]

CACHE_WRITE_WORDS = ["write", "creation", "create", "store"]
REASONING_WORDS = ["reason", "think", "thought"]
INPUT_KEYS = ["input", "prompt", "promptevalcount"]
INPUT_WORDS = ["input", "prompt"]
OUTPUT_KEYS = ["output", "completion", "candidates", "evalcount"]
OUTPUT_WORDS = ["output", "completion", "candidate", "generated"]
COUNT_WORDS = ["token", "count"]

# Keys tried, in order, when a count is wrapped in an object.
COUNT_BOXES = ["tokens", "token", "count", "total", "value", "amount", "n"]

# Folded keys holding one usage object per model.
MODEL_GROUPS = ["models", "modelusage", "modelstats"]

TURN_TYPES = [
    "turn.completed", "turn_completed", "step_finish", "step-finish", "step_complete", "step-complete",
    "message_update", "usage.record", "usage_record",
]
SESSION_TYPES = [
    "result", "token_count", "message_end", "turn_end", "agent_end", "session", "session_end", "final",
]
RECORD_TYPES = ["usage.record", "usage_record"]
TURN_SCOPES = ["turn", "step", "delta", "increment", "item"]
SESSION_SCOPES = ["session", "total", "cumulative", "run", "overall"]

# Session-log scan.
SKIPPED_FOLDERS = [
    ".git", "_grade", "node_modules", "__pycache__", ".tmp", ".venv", ".tox", ".mypy_cache", ".pytest_cache",
    ".eggs", ".hg", ".svn", ".idea", ".vscode",
]
SESSION_NAME_WORDS = ["session", "usage", "token", "transcript", "rollout"]
HOME_SLACK_SECONDS = 2

# Watched folders and files that never count as activity.
UNWATCHED_FOLDERS = [".git", ".tmp", "_grade", "__pycache__"]
UNWATCHED_FILES = ["instruction.md", "seatbelt.sb", ".DS_Store"]

REPEAT_GAP_MS = 2_000
HEARTBEAT_MS = 15_000
HEARTBEAT_SLACK_MS = 500

CHARS_PER_UNIT = 4
CHECK_NAME = "extract-json"

# Harness catalogue ids, by short name.
CATALOG_IDS = {
    "claude": "hrs_claude",
    "chatgpt": "hrs_chatgpt",
    "gemini": "hrs_gemini",
    "grok": "hrs_grok",
    "qwen": "hrs_qwen",
    "kimi": "hrs_kimi",
    "deepseek": "hrs_deepseek",
    "opencode": "hrs_opencode",
    "pi": "hrs_pi",
    "api": "hrs_api",
    "custom": "hrs_custom",
}
DEFAULT_CATALOG_ID = "hrs_custom"

# Hints for failed tests, by test name, and the one for all others.
HINTS = {
    "test_visibility_timeout_restores_and_counts_attempt": "After lease, ready_count must be 0 and leased_count 1. When the visibility window ends, the same message is ready again and attempts + 1.",
    "test_nack_then_poison": "nack with a matching lease_id increments attempts. After max_attempts failed nacks or expiries, lease returns None and dead_count increases.",
    "test_persist_across_processes": "A new Queue(path=...) must reload leased state (leased_count and lease_id). ack on that reloaded queue deletes the message.",
    "test_delay_does_not_steal_older_ready": "lease the oldest ready message (available_at, then id). A delayed newer message must not be leased before an older ready one.",
    "test_visibility_expires_and_counts_attempt": "Visibility expiry must restore the message and increment attempts.",
    "test_nack_increments_attempts": "nack with the active lease_id increments attempts.",
    "test_dead_after_max_attempts": "After max_attempts failed attempts the message is dead and not leaseable.",
    "test_persist_leased_message": "Disk state must include the active lease, not only the body list.",
    "test_window_edge_is_exclusive": "A hit that is exactly window_ms old is outside the sliding window.",
    "test_remaining_does_not_record": "remaining must not add a hit. It only reports how many allows are left.",
    "test_token_bucket_cost_and_cap": "token_bucket spends cost tokens, refills at rate_per_sec, and caps at burst.",
    "test_window_and_bucket_do_not_share_state": "Sliding-window hits and token-bucket tokens for the same key are independent.",
    "test_reset_clears_bucket_only_for_that_key": "reset(key) clears window and bucket state for that key only.",
    "test_persist_bucket_across_processes": "A new Limiter(path=...) must reload token-bucket tokens and last refill time.",
    "test_pointer_escapes": "JSON Pointer ~1 is / and ~0 is ~. Decode ~1 first.",
    "test_array_insert_shifts": "add on an array index inserts and shifts later items right.",
    "test_remove_array_index": "remove on an array index deletes that item.",
    "test_empty_path_replaces_document": 'path "" is the whole document.',
    "test_add_missing_parent_raises": "add must not create missing parents. Raise PatchError.",
    "test_unsupported_op_raises": "Only add, remove, replace, and test are required. Other ops raise PatchError.",
}
DEFAULT_HINT = "Re-read that required behavior in the prompt."

# Agent events: who speaks, and what kinds of event there are.
ACTORS = ["assistant", "user", "system"]
TOOL_TYPES = ["tool_use", "tool_call", "tool", "function_call", "tool_request"]
SPEECH_TYPES = ["assistant", "message"]
ERROR_TYPES = ["error", "turn.failed", "stream_error"]
TURN_EVENT_TYPES = ["turn.completed", "turn.started", "item.completed"]

# Keys of an event and of its arguments that name what a tool works on, and those that hold a file.
OWN_TARGETS = ("file_path", "filePath", "path", "filename", "command", "cmd")
ARGUMENT_TARGETS = ("file_path", "filePath", "path", "target_file", "command")
FILE_KEYS = ("file_path", "path", "filename", "target_file")

# Lines of a verbose test log.
TEST_RAN = r"(?mdU)^(\S+) \([^)]+\) \.\.\. (ok|FAIL|ERROR|skipped).*$"
TEST_HEADER = r"(?mdU)^(?:FAIL|ERROR): (\S+)"
TEST_RAISED = r"(?mdU)^(?:AssertionError|Error|TypeError|ValueError|AttributeError): (.+)$"
