"""Pluggable models: embedders and chat models, with deterministic offline ones."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class ModelError(Exception):
    """A failed model call; status is an HTTP-like code, or None where no answer came."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    """``options`` comes as a second argument where a caller sets any."""

    def chat(self, prompt: str, options: dict[str, object] | None = None) -> str: ...


def build_options(temperature: float | None = None, top_p: float | None = None, max_tokens: int | None = None, seed: int | None = None, stop: list[str] | None = None) -> dict[str, object]:
    """Options of a model call: those that are given, the length under the name that local servers use."""
    named = {"temperature": temperature, "top_p": top_p, "num_predict": max_tokens, "seed": seed, "stop": stop}
    return {name: value for name, value in named.items() if value is not None}


def retryable(error: Exception) -> bool:
    """Client errors are final, all others may pass."""
    status = getattr(error, "status", None)
    return status is None or not 400 <= status < 500


def with_retry(call: Callable, attempts: int = 3, base_delay: float = 1.0, sleep: Callable = time.sleep):
    """Call until it succeeds, at most ``attempts`` times (1 at least), the delay doubling each time."""
    for n in range(1, max(1, attempts) + 1):
        try:
            return call()
        except Exception as error:
            if n >= max(1, attempts) or not retryable(error):
                raise
            sleep(base_delay * 2 ** (n - 1))


class HashEmbedder:
    """Feature hashing of lower-case words into unit vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(row))
            if norm:
                row /= norm
        return out.tolist()


class LetterEmbedder:
    """How often each letter of a to z occurs: a stand-in that SQL can compute too."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for low in map(str.lower, texts)]


class ScriptedChat:
    """Answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def chat(self, prompt: str, options: dict[str, object] | None = None) -> str:
        return self.answer(prompt)

    @classmethod
    def capitalised_names(cls) -> ScriptedChat:
        """An extractor that takes capitalised words for concepts."""

        def answer(prompt: str) -> str:
            names = dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", prompt.partition("\n\nText:\n")[2] or prompt))
            return json.dumps({"entities": [{"name": n, "type": "CONCEPT"} for n in names], "relationships": []})

        return cls(answer)

    @classmethod
    def assistant(cls) -> ScriptedChat:
        """Condenses to the question itself, words it anew by leaving out its first or last word, and scores
        passages by the words that they share with the question."""

        def answer(prompt: str) -> str:
            question = prompt.partition("Question: ")[2].partition("\n\n")[0]
            words = question.split()
            if "Passages:" in prompt:
                lines = prompt.partition("Passages:\n")[2].rpartition("\n\n")[0]
                passages = re.split(r"(?m)^\[\d+\] ", lines)[1:]
                return json.dumps([{"index": n, "score": 10 * len(set(words) & set(p.split())) / max(1, len(words))} for n, p in enumerate(passages)])
            return json.dumps([" ".join(words[1:]), " ".join(words[:-1])]) if "JSON array" in prompt else question

        return cls(answer)

    @classmethod
    def first_half(cls) -> ScriptedChat:
        """A reworder: the first half of the words that were searched for."""

        def answer(prompt: str) -> str:
            words = prompt.rpartition("Searched for: ")[2].split()
            return " ".join(words[: max(1, len(words) // 2)])

        return cls(answer)

    @classmethod
    def word_overlap(cls) -> ScriptedChat:
        """A grader: 10 times the share of the question's words that each snippet has."""

        def answer(prompt: str) -> str:
            head, *snippets = prompt.split("\n\x1e")
            asked = set(head.rpartition("Question: ")[2].lower().split())
            return json.dumps([{"index": n, "score": round(10 * len(asked & set(s.lower().split())) / max(1, len(asked)), 3)} for n, s in enumerate(snippets)])

        return cls(answer)


def embed(rows: DataFrame, model: Embedder, column: str = "text", prefix: str = "", batch: int = 32, attempts: int = 3) -> DataFrame:
    """Add a column embedding, made in batches of bounded size; nulls count as empty texts."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"

    def run(batches):
        for part in batches:
            texts = [prefix + (t or "") for t in part.column(part.schema.get_field_index(column)).to_pylist()]
            made: list = []
            for at in range(0, len(texts), batch):
                made += with_retry(lambda at=at: model.embed(texts[at : at + batch]), attempts)
            if len(made) != len(texts):
                raise ModelError("the embedder gave another number of vectors than texts")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    return rows.mapInArrow(run, shape)


def ask(rows: DataFrame, model: ChatModel, prompt: str, attempts: int = 3, base_delay: float = 1.0, fallback: ChatModel | None = None, options: dict[str, object] | None = None) -> DataFrame:
    """Add a column reply to the prompts in a column; a call that keeps failing, with a delay that doubles,
    goes to ``fallback``, and gives null if there is none or it fails too.  ``options``: see build_options."""
    more = (options,) if options else ()
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reply string"

    def one(text: str | None) -> str | None:
        for each in filter(None, (model, fallback)):
            try:
                return with_retry(lambda each=each: each.chat(text or "", *more), attempts, base_delay)
            except Exception:
                continue
        return None

    def run(batches):
        for part in batches:
            replies = [one(t) for t in part.column(part.schema.get_field_index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string())], [*part.schema.names, "reply"])

    return rows.mapInArrow(run, shape)
