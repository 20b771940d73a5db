"""Oracles answer questions about a request with probabilities over options that code has listed."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

BATCH, PARALLEL, RETRIES, TIMEOUT_S = 120, 6, 3, 60


@dataclass(frozen=True)
class Question:
    """kind 'choice' (2 to 255 options), 'score' (2 to 10 levels) or 'noul' (yes or no)."""

    kind: str
    text: str
    options: tuple[str, ...] = ("yes", "no")

    def __post_init__(self):
        most = {"choice": 255, "score": 10, "noul": 2}[self.kind]
        if not 2 <= len(self.options) <= most:
            raise ValueError(f"{self.kind} with {len(self.options)} options")


Answer = dict[str, float]
Questions = dict[str, Question]


class Oracle(Protocol):
    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]: ...


def normalized(weights: Answer) -> Answer:
    total = sum(max(0.0, w) for w in weights.values())
    return {k: max(0.0, w) / total if total else 1 / len(weights) for k, w in weights.items()}


def margin(a: Answer) -> float:
    top = sorted(a.values(), reverse=True)
    return top[0] - (top[1] if len(top) > 1 else 0.0)


def averaged(a: Answer, b: Answer) -> Answer:
    return {k: (a.get(k, 0) + b.get(k, 0)) / 2 for k in a | b}


class CachingOracle:
    """Remembers answers by state and question, on disk if a folder is given."""

    def __init__(self, inner: Oracle, folder: str | Path | None = None):
        self.inner, self.folder, self.known = inner, Path(folder) if folder else None, {}

    @staticmethod
    def _key(state: dict, name: str, q: Question) -> str:
        return hashlib.sha256(json.dumps([state, name, q.kind, q.text, q.options], sort_keys=True, default=str).encode()).hexdigest()

    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]:
        keys = {n: self._key(state, n, q) for n, q in questions.items()}
        for k in keys.values():
            if k not in self.known and self.folder and (self.folder / f"{k}.json").exists():
                self.known[k] = json.loads((self.folder / f"{k}.json").read_text())
        open_ = {n: q for n, q in questions.items() if keys[n] not in self.known}
        for n, a in (self.inner.ask(state, open_) if open_ else {}).items():
            self.known[keys[n]] = a
            if self.folder:
                self.folder.mkdir(parents=True, exist_ok=True)
                (self.folder / f"{keys[n]}.json").write_text(json.dumps(a))
        return {n: self.known[k] for n, k in keys.items()}


class RecordingOracle:
    """Keeps what was asked and answered."""

    def __init__(self, inner: Oracle):
        self.inner, self.log = inner, []

    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]:
        got = self.inner.ask(state, questions)
        self.log.append((state, questions, got))
        return got


class HttpOracle:
    """Questions as JSON to a decision service: batches, in parallel, with retries on overload."""

    def __init__(self, url: str, token: str = "", send: Callable[[bytes], bytes] | None = None, wait_s: float = 0.5):
        self.url, self.token, self.wait_s = url, token, wait_s
        self.send = send or self._post

    def _post(self, body: bytes) -> bytes:
        r = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"})
        with urllib.request.urlopen(r, timeout=TIMEOUT_S) as f:
            return f.read()

    def _call(self, state: dict, part: list[tuple[str, Question]]) -> dict[str, Answer]:
        body = json.dumps({"state": state, "questions": {n: {"kind": q.kind, "text": q.text, "options": q.options} for n, q in part}}).encode()
        for attempt in range(RETRIES + 1):
            try:
                got = json.loads(self.send(body))
                return {n: normalized({o: float(got[n].get(o, 0)) for o in q.options}) for n, q in part}
            except OSError as e:
                status = getattr(e, "code", 503)
                if attempt == RETRIES or not (status == 429 or status >= 500):
                    raise
                time.sleep(self.wait_s * 2**attempt)
        raise AssertionError

    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]:
        all_ = list(questions.items())
        parts = [all_[i : i + BATCH] for i in range(0, len(all_), BATCH)]
        with ThreadPoolExecutor(PARALLEL) as pool:
            return {n: a for got in pool.map(lambda p: self._call(state, p), parts) for n, a in got.items()}


class LogprobOracle:
    """Options as single-letter labels to a model that returns the log-probabilities of the next token; many options go in two steps."""

    LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def __init__(self, next_token: Callable[[str], dict[str, float]]):
        self.next_token = next_token

    def _one(self, state: dict, text: str, options: tuple[str, ...]) -> Answer:
        import math

        n = len(self.LABELS)
        if len(options) > n:
            groups = [options[i : i + n] for i in range(0, len(options), n)]
            outer = self._one(state, f"{text} Which group holds the answer?", tuple("; ".join(g) for g in groups))
            return {o: p * w for g in groups for p in [outer["; ".join(g)]] for o, w in self._one(state, text, g).items()} if len(groups) > 1 else self._one(state, text, groups[0])
        labels = self.LABELS[: len(options)]
        prompt = f"{json.dumps(state, default=str)}\n{text}\n" + "\n".join(f"{a}. {o}" for a, o in zip(labels, options, strict=True)) + "\nAnswer with one letter:"
        got = self.next_token(prompt)
        floor = min(got.values(), default=0.0) - 1
        return normalized({o: math.exp(got.get(a, floor)) for a, o in zip(labels, options, strict=True)})

    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]:
        return {n: self._one(state, q.text, q.options) for n, q in questions.items()}
