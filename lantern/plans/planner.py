"""Questions to query plans, without a language model."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

# What a plan may hold.
INTENTS = {"entity_lookup", "event_lookup", "timeline_query", "connection_query", "semantic"}
OPERATIONS = {"find_entity", "find_events", "next_events", "prev_events", "between_events", "find_connection", "caused_by", "free_search"}
# Words that don't belong to a name at its ends.
QUESTION_WORDS = set(
    "what who whom when where how why which whose did do does is are was were the a an in on of to after before with and or can could tell about there it its happen happened cause caused belong made create created".split()
)
#: Words of a name, and names of a plan, at most; characters of its other fields.
SPAN, NAMES, FIELD = 4, 6, 160


@dataclass(frozen=True)
class Plan:
    entities: tuple[str, ...] = ()
    intent: str = "semantic"
    operation: str = "free_search"
    reference_event: str | None = None
    scope: str | None = None
    temporal_constraint: str | None = None
    extra: dict[str, Any] = field(default_factory=dict, compare=False)


# Fixed value: a word of a name.
NAME_WORD = re.compile(r"[A-Z][A-Za-z'.-]*")


def _capitalised(word: str) -> bool:
    return NAME_WORD.fullmatch(word) is not None


def entities_of(question: str) -> list[str]:
    """Names: runs of capitalised words, of SPAN words at most, without question words at their ends."""
    tokens = [(w, _capitalised(w)) for w in re.findall(r"[A-Za-z'.-]+|[^\sA-Za-z'.-]+", question)]
    runs: list[list[str]] = [[]]
    for word, capital in tokens:
        if capital and len(runs[-1]) < SPAN:
            runs[-1].append(word)
        else:
            runs.append([word] if capital else [])
    names = []
    for run in runs:
        own = [k for k, w in enumerate(run) if w.lower() not in QUESTION_WORDS]
        if own:
            names.append(" ".join(run[own[0] : own[-1] + 1]))
    return names[:NAMES]


def is_simple_name(question: str) -> bool:
    """Whether the question is nothing but a name."""
    words = question.split()
    return 0 < len(words) <= SPAN and all(map(_capitalised, words)) and question.strip()[-1] not in "?.!,"


def plan(question: str, scope: str | None = None) -> Plan:
    if is_simple_name(question):
        return Plan((question.strip(),), "entity_lookup", "find_entity", scope=scope)
    return Plan(tuple(entities_of(question)), scope=scope)


def _names(value: Any) -> tuple[str, ...]:
    return tuple(filter(None, (str(v).strip() for v in value or ())))[:NAMES] if isinstance(value, list | tuple | None) else ()


def _text(value: Any) -> str | None:
    return None if value is None else str(value)[:FIELD] or None


def coerce(raw: Any, scopes: set[str] | None = None) -> Plan:
    """The usable part of a plan that a model has written: each field by its own rule, or as in an empty plan."""
    rules = {
        "entities": _names, "reference_event": _text, "temporal_constraint": _text,
        "intent": lambda v: v if v in INTENTS else Plan.intent, "operation": lambda v: v if v in OPERATIONS else Plan.operation, "scope": lambda v: v if scopes is None or v in scopes else None,
    }
    held = raw if isinstance(raw, dict) else {}
    return Plan(**{name: rule(held[name]) for name, rule in rules.items() if name in held})
