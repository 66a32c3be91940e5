"""Context packs for an assistant: tiered episode blocks within a character budget, prompts and reply parsers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from mnesis.functions.text import NO_WORDS, YES_WORDS


@dataclass
class Turn:
    question: str
    answer: str
    episode_ids: list[str] = field(default_factory=list)


def build_context(episodes: list[dict], budget: int = 8000, reserve: int = 200, full: int = 3, short: int = 4) -> str:
    """Ranked episodes as text: the first in full, the next in a line each, the rest as one count.

    A full block that does not fit is replaced by its one-line form without being charged, as the
    order of blocks is a fold that depends on what fitted before. ``episodes`` is a top-k result.
    """
    left, out = budget - reserve, []
    for i, e in enumerate(episodes[: full + short]):
        line = f"- {e['episode_id']}: {e.get('label') or ''} ({e.get('relevance', 0):.2f})"
        block = "\n".join([line, f"  {e.get('summary') or ''}", *[f"  « {q} »" for q in e.get("quotes", [])]]) if i < full else line
        if len(block) > left:
            out.append(line[: max(left, 0)])
            continue
        out.append(block)
        left -= len(block)
    rest = len(episodes) - full - short
    if rest > 0:
        out.append(f"(+ {rest} more)")
    return "\n".join(out)[:budget]


class MemoryAgent:
    """Answers with an injected model: ``model(system, user) -> str``; recall is injected as well."""

    def __init__(self, recall: Callable[[str, int], list[dict]], model: Callable[[str, str], str] | None = None, top_k: int = 10):
        self.recall, self.model, self.top_k, self.turns = recall, model, top_k, []

    def respond(self, question: str) -> str:
        found = self.recall(question, self.top_k)
        context = build_context(found)
        answer = self.model(f"Memory:\n{context}", question) if self.model else context
        self.turns.append(Turn(question, answer, [e["episode_id"] for e in found]))
        return answer

    def explain_last(self) -> str:
        return ", ".join(self.turns[-1].episode_ids) if self.turns else ""


# Names of entity types as models write them.
TYPE_NAMES = {"PERSON": "PERSON", "PER": "PERSON", "ORGANIZATION": "ORG", "ORG": "ORG", "LOCATION": "PLACE", "LOC": "PLACE", "PLACE": "PLACE", "PRODUCT": "PRODUCT", "EVENT": "EVENT", "DATE": "DATE_EVENT", "PROJECT": "PROJECT", "DOCUMENT": "DOCUMENT"}


def _object(reply: str) -> dict:
    """The JSON object in a reply, with fences and trailing commas forgiven; empty when there is none."""
    m = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", reply or ""), re.DOTALL)
    if not m:
        return {}
    for text in (m.group(), re.sub(r",\s*([}\]])", r"\1", m.group())):
        try:
            found = json.loads(text)
            return found if isinstance(found, dict) else {}
        except ValueError:
            continue
    return {}


def parse_entities(reply: str) -> list[dict]:
    rows = _object(reply).get("entities") or []
    out = []
    for r in rows:
        if isinstance(r, dict) and str(r.get("text") or "").strip():
            try:
                confidence = min(1.0, max(0.0, float(r.get("confidence", 0.8))))
            except (TypeError, ValueError):
                confidence = 0.8
            out.append({"text": str(r["text"]).strip(), "type": TYPE_NAMES.get(str(r.get("type") or "").upper(), "UNKNOWN"), "confidence": confidence})
    return out


def parse_entities_of_many(reply: str) -> dict[str, list[dict]]:
    return {k: parse_entities(json.dumps(v)) for k, v in _object(reply).items() if isinstance(v, dict)}


def parse_summary(reply: str) -> dict:
    o = _object(reply)
    return {"label": str(o.get("label") or "")[:80], "summary": str(o.get("summary") or reply or "").strip(), "keywords": [str(k) for k in o.get("keywords") or []], "mood": str(o.get("mood") or "neutral")}


def parse_boundary(reply: str) -> float:
    """Probability of a boundary; the confidence counts for what the reply says."""
    o = _object(reply)
    if isinstance(o.get("boundary"), bool):
        try:
            c = min(1.0, max(0.0, float(o.get("confidence", 0.5))))
        except (TypeError, ValueError):
            c = 0.5
        return c if o["boundary"] else 1 - c
    low = (reply or "").lower()
    if re.search(YES_WORDS, low):
        return 0.6
    return 0.4 if re.search(NO_WORDS, low) else 0.7  # unreadable: no boundary, with little confidence
