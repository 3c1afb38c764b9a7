"""Constants of the export: sizes, caps, markers and kinds.  Fixed values, all open to parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PackConfig:
    """Chunk sizes in estimated tokens."""

    target: int = 90_000
    hard: int = 200_000
    least: int = 40_000


KEPT_TYPES = ("user", "assistant")
#: Entry types that are dropped, and why.
DROPPED_TYPES = {
    "mode": "setting", "permission-mode": "setting", "ai-title": "label", "file-history-snapshot": "file state", "file-history-delta": "file state",
    "last-prompt": "repeat", "queue-operation": "control", "attachment": "binary", "system": "system notice",
}
THINKING_CAP, THINKING_HEAD, THINKING_TAIL = 400, 200, 100
RESULT_CAP, RESULT_HEAD, RESULT_TAIL = 600, 500, 200
OMITTED, OMITTED_END, ERROR_INFO = "\n[...omitted...]\n", "\n[...omitted...]", "\n[...error info...]\n"
COMMAND_CAP, EDIT_CAP, WRITE_CAP, PROMPT_CAP, INPUT_CAP = 500, 100, 200, 300, 300
#: What share of each kind's tokens survives truncation; a planning estimate.
RETENTION = {"user_text": 1.0, "assistant_text": 1.0, "thinking": 0.3, "tool_use": 0.4, "tool_result": 0.2}
#: Real tokens per estimated one.
SAFETY_FACTOR = 1.68
RECENT_LINES = 500

STATUSES = ("D", "V", "X")
CATEGORIES = ("facts", "pitfalls", "state", "growth-notes", "prompt-improvements", "alignment", "decisions")
#: Which syncs touch which categories.
SCOPES = {"all": CATEGORIES, "kb": ("facts", "pitfalls", "state", "decisions"), "growth": ("growth-notes", "prompt-improvements"), "alignment": ("alignment",)}
#: Who reads a category.
CONSUMERS = {"facts": "AI", "pitfalls": "AI", "state": "AI", "growth-notes": "Human", "prompt-improvements": "Human", "alignment": "Human+AI", "decisions": "Human+AI"}
#: What a reader needs, and the one category it is in.
ROUTES = {
    "environment": "facts", "errors": "pitfalls", "progress": "state", "learning": "growth-notes", "prompt advice": "prompt-improvements", "alignment": "alignment", "decisions": "decisions",
}
TRIAGE_LABELS = ("needs-triage", "needs-info", "ready-for-agent", "ready-for-human", "wontfix")
SIMILAR = 0.90
