"""Language models behind interfaces: chat with retries, JSON replies, answers that are checked."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .planner import Plan, coerce, is_simple_name
from .planner import plan as plain_plan

FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
NO_EVIDENCE = "No evidence was found for this question."
NOTES = {"kept": "Some sentences could not be traced to the evidence.", "failed": "A second attempt at a better answer failed."}


class ModelError(Exception):
    """A reply that can't be used."""


@dataclass
class Reply:
    """What a transport gives back."""

    status: int
    text: str | None = None
    retry_after: float | None = None


@dataclass
class Chat:
    """send(messages, temperature) is the transport; it may raise OSError."""

    send: Callable[[list[dict], float], Reply]
    attempts: int = 4
    longest_wait: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def ask(self, messages: list[dict], temperature: float = 0.2) -> str:
        """The reply's text. Busy and broken servers and transports are tried again, other refusals aren't."""
        fault = "no attempt"
        for attempt in range(self.attempts):
            wait = min(self.longest_wait, 2.0**attempt)
            try:
                reply = self.send(messages, temperature)
            except OSError as e:
                fault = str(e)
            else:
                if reply.status == 200:
                    if reply.text is None:
                        raise ModelError("a reply without content")
                    return reply.text
                fault = f"status {reply.status}"
                if reply.status == 429:
                    wait = min(self.longest_wait, wait if reply.retry_after is None else reply.retry_after)
                elif reply.status < 500:
                    break
            if attempt + 1 < self.attempts:
                self.sleep(wait)
        raise ModelError(fault)

    def ask_json(self, messages: list[dict], temperature: float = 0.2) -> Any:
        """The reply as JSON, out of its fence; a reply that isn't JSON is shown to the model once, to repair."""
        said = self.ask(messages, temperature)
        try:
            return read_json(said)
        except ValueError as e:
            repair = [*messages, {"role": "assistant", "content": said}, {"role": "user", "content": f"This is not valid JSON ({e}). Reply with the corrected JSON alone."}]
            try:
                return read_json(self.ask(repair, 0.0))
            except ValueError as again:
                raise ModelError(f"no JSON: {again}") from again


def read_json(text: str) -> Any:
    held = FENCE.match(text)
    return json.loads(held[1] if held else text)


def model_planner(chat: Chat, scopes: set[str] | None = None) -> Callable[[str, str | None], Plan]:
    """A planner that asks the model, except for plain names; whatever goes wrong gives a free search."""

    def plan(question: str, scope: str | None = None) -> Plan:
        if is_simple_name(question):
            return plain_plan(question, scope)
        try:
            found = coerce(chat.ask_json([{"role": "user", "content": f"Reply with a JSON plan for the question: {question}"}], 0.0), scopes)
        except ModelError:
            found = Plan()
        return Plan(found.entities, found.intent, found.operation, found.reference_event, scope or found.scope, found.temporal_constraint)

    return plan


def checked_answer(question: str, evidence: list[dict], write: Callable[[str, list[dict], float], str], faithful: Callable[[str, list[dict]], bool]) -> tuple[str, str | None]:
    """(answer, note). An answer that the evidence doesn't bear is written once more; the first stays if that is no better."""
    if not evidence:
        return NO_EVIDENCE, None
    first = write(question, evidence, 0.2)
    if faithful(first, evidence):
        return first, None
    try:
        second = write(question, evidence, 0.0)
    except Exception:  # noqa: BLE001  the first answer is still there
        return first, NOTES["failed"]
    return (second, None) if faithful(second, evidence) else (first, NOTES["kept"])


def citation_html(answer: str, most: int = 6) -> str:
    """The answer for a page: escaped, citations of shown slots as links."""
    safe = escape(answer)
    return re.sub(r"\[(\d+)\]", lambda m: f'<a href="#slot-{m[1]}">[{m[1]}]</a>' if 1 <= int(m[1]) <= most else m[0], safe)


def evidence_html(evidence: list[dict], cut: int = 220) -> str:
    rows = (f'<li id="slot-{e["slot"]}"><b>{escape(str(e.get("scope") or "")).upper()}</b> {escape(e["quote"][:cut])}</li>' for e in evidence)
    return f"<ol>{''.join(rows)}</ol>"


def escape(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(a, b)
    return text
