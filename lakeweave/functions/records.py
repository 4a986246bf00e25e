"""Model output and configuration: JSON in text, shape checks, intervals, retries."""

from __future__ import annotations

import json
import re
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_fences


def first_block(text: str) -> str | None:
    """The first balanced [...] or {...} of a text, brackets in strings aside."""
    m = re.search(r"[\[{]", text)
    if not m:
        return None
    depth, inside, skip = 0, False, False
    for i in range(m.start(), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[m.start() : i + 1]
    return None


def parse_reply(text: str):
    """The JSON value in a model's reply, fences aside; ValueError without one."""
    bare = re.sub(r"^\s*```[A-Za-z]*\s*\n?|\n?```\s*$", "", text)
    block = first_block(bare)
    if block is None:
        raise ValueError("no JSON in the reply")
    return json.loads(block)


def reply_json(text: Column) -> Column:
    """As a column: the JSON in a reply, null where there is none that parses."""

    @F.pandas_udf("string")
    def run(s):
        def one(x):
            try:
                return None if x is None else json.dumps(parse_reply(x))
            except ValueError:
                return None

        return s.map(one)

    return run(without_fences(text))


def answer_errors(value) -> list[str]:
    """What is wrong with an answer {answer: [{text, source?: {documentId, range}}], followUpQuestions: [text]}; nothing if it is right."""
    out = []
    if not isinstance(value, dict):
        return ["not an object"]
    if not isinstance(value.get("answer"), list) or not value["answer"]:
        out.append("answer is no list with entries")
    for i, a in enumerate(value.get("answer") or []):
        if not isinstance(a, dict) or not isinstance(a.get("text"), str) or not a["text"].strip():
            out.append(f"answer {i}: no text")
            continue
        s = a.get("source")
        if s is not None and not (isinstance(s, dict) and isinstance(s.get("documentId"), str) and isinstance(s.get("range"), list) and len(s["range"]) == 2 and all(isinstance(x, int) for x in s["range"]) and 0 <= s["range"][0] < s["range"][1]):
            out.append(f"answer {i}: bad source")
    follow = value.get("followUpQuestions", [])
    if not isinstance(follow, list) or not all(isinstance(q, str) for q in follow):
        out.append("followUpQuestions is no list of texts")
    return out


def theme_errors(value, themes: set[str]) -> list[str]:
    """What is wrong with a classification {theme, confidence, rationale}."""
    if not isinstance(value, dict):
        return ["not an object"]
    out = [] if value.get("theme") in themes else ["unknown theme"]
    c = value.get("confidence")
    if not isinstance(c, (int, float)) or isinstance(c, bool) or not 0 <= c <= 1:
        out.append("confidence is not from 0 to 1")
    return out if isinstance(value.get("rationale"), str) and value["rationale"].strip() else [*out, "no rationale"]


def row_texts(value) -> list[str]:
    """Texts of augmented rows: questions, anchors and variants, blank ones left out."""
    out: list[str] = []
    for row in value if isinstance(value, list) else []:
        if isinstance(row, dict):
            for x in (row.get("question"), *(row.get("anchors") or []), *(row.get("variants") or [])):
                if isinstance(x, str) and x.strip():
                    out.append(x.strip())
    return out


def get_path(value, path: str):
    """A dotted path in nested dicts; None where it ends."""
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def deep_assign(into: dict, other: dict) -> dict:
    """``into`` with ``other``'s values, dicts within merged."""
    for k, v in other.items():
        into[k] = deep_assign(dict(into[k]), v) if isinstance(v, dict) and isinstance(into.get(k), dict) else v
    return into


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether half-open intervals overlap."""
    return F.greatest(a0, b0) < F.least(a1, b1)


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Their common part as a struct; null if empty."""
    return F.when(intersects(a0, a1, b0, b1), F.struct(F.greatest(a0, b0).alias("start"), F.least(a1, b1).alias("end")))


def contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (b1 <= a1)


def with_retry(call: Callable, check: Callable = lambda _: [], attempts: int = 3, fallback: Callable | None = None):
    """``call(errors of the last try)`` until ``check`` finds nothing; else the fallback, or the last errors as ValueError."""
    errors: list[str] = []
    for _ in range(attempts):
        try:
            out = call(errors)
        except ValueError as e:
            errors = [str(e)]
            continue
        errors = list(check(out))
        if not errors:
            return out
    if fallback is not None:
        return fallback(errors)
    raise ValueError("; ".join(errors))


class RateLimit:
    """A token bucket: ``take`` waits until the rate allows another call."""

    def __init__(self, per_second: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
            self.at = now
            if self.tokens < 1:
                wait = (1 - self.tokens) / self.rate
                self.sleep(wait)
                self.at, self.tokens = self.at + wait, 1.0
            self.tokens -= 1


class Slots:
    """At most so many calls at a time; those that wait get their turn in the order in which they came."""

    def __init__(self, most: int):
        self.free, self.waiting, self.lock = most, deque(), threading.Lock()

    def run(self, call: Callable):
        turn = threading.Event()
        with self.lock:
            if self.free and not self.waiting:
                self.free -= 1
                turn.set()
            else:
                self.waiting.append(turn)
        turn.wait()
        try:
            return call()
        finally:
            with self.lock:
                if self.waiting:
                    self.waiting.popleft().set()
                else:
                    self.free += 1
