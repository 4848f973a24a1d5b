"""Vocabularies, limits and patterns that results depend on."""

from __future__ import annotations

# Tiers, from the most to the least condensed
HIGH_TIERS = ("asset", "overview", "ledger")
ALL_TIERS = ("asset", "overview", "ledger", "fact_block", "core")

# Kinds of asset
ASSET_TYPES = ("decisions", "unresolved", "failures", "capabilities", "preferences")

# Strength of a status group
STATUS_STRENGTH = {"verified": 6, "executed": 5, "mixed": 4, "planned": 3, "blocked": 2, "failed": 2, "uncertain": 1}

# What a tier adds to a score
TIER_BONUS = {"asset": 0.35, "overview": 0.30, "ledger": 0.20, "fact_block": 0.10, "core": 0.0}

# Kinds of relation between records
RELATION_TYPES = ("supersedes", "resolves", "contradicts", "supports", "refines", "reopens", "validates", "invalidates")

# Categories of events by role
EVENT_CATEGORIES = {"user": "user_intent", "assistant": "assistant_response", "tool_call": "tool_call", "tool_output": "tool_output", "goal": "goal_state"}

# Status patterns (any case)
FAILURE = r"\b(error|failed|failure|exception|traceback|exit code [1-9]|timed out|timeout|blocked)\b|失败|报错|异常|阻塞|超时"
VERIFIED = r"\b([1-9]\d* passed|exit code 0|tests? passed|build succeeded|verified)\b|测试通过|构建成功|已验证"

# Asset patterns (any case)
DECISION = r"决定|采用|选择|同意|确定|保留|放弃|\b(decided|choose|adopt|selected)\b"
PREFERENCE = r"必须|不要|不需要|希望|偏好|要求|只允许|\b(prefer|must|should not|require)\b"
UNRESOLVED = r"待|仍需|尚未|未解决|不确定|计划|下一步|\b(todo|pending|unresolved|uncertain|planned)\b"

# Openings of messages that are context for the model, not words of a person
INTERNAL_CONTEXT = (
    "<environment_context>",
    "<permissions instructions>",
    "<collaboration_mode>",
    "<skills_instructions>",
    "<apps_instructions>",
    "<plugins_instructions>",
)

# Default aliases (alias, canonical)
DEFAULT_ALIASES = (
    ("wsl2", "wsl"),
    ("visual studio code", "vscode"),
    ("vs code", "vscode"),
    ("knowledge base", "知识库"),
    ("transcript", "会话记录"),
    ("conversation", "会话"),
    ("tool call", "工具调用"),
)

# Lengths in characters
ASSET_CHARS = 1600
ASSERTION_CHARS = 800
PROJECTION_CHARS = 3900

# ranking
BM25_K1, BM25_B = 1.2, 0.75
LEXICAL_QUOTA, LEXICAL_LEAST = 24, 160
SEMANTIC_QUOTA, SEMANTIC_LEAST = 100, 600
BODY_WEIGHT, TITLE_WEIGHT, STRENGTH_WEIGHT = 1.4, 0.15, 0.01
ARTIFACT_WEIGHTS = (8.0, 4.0, 2.0, 2.0)

# The pattern of a search term, and the days of a window's unit
QUERY_TERM = r'-?"[^"]+"|-?\S+'
WINDOW_DAYS = {"h": 1 / 24, "d": 1, "w": 7, "m": 30, "y": 365}

#: Fixed values of search: the weights that divide the scores of the two full-text engines, and
#: the classifier whose assets are no longer shown.
BODY_ENGINE, TITLE_ENGINE = 8.0, 1.0
OUTDATED_CLASSIFIER = "deterministic-asset-classifier-v1"
