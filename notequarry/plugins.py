"""Where models plug in, and defaults that need none: deterministic, offline.

An Embedder turns texts into vectors, an Extractor texts into entities, a Generator a prompt into a text. Real endpoints
implement the same protocols; retried() gives them another two attempts.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol, TypeVar

import numpy as np

from .functions.texts import slug

T = TypeVar("T")
#: The kinds of entities asked for by default.
LABELS = ("person", "organization", "location", "technology", "language", "framework", "library", "tool", "database", "concept", "event", "product")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def extract(self, texts: Sequence[str]) -> list[list[dict]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of words at signed hashed places, scaled to length one; without signs where all of them cancel out."""

    dimension: int = 256

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts):
            words = re.findall(r"[^\W_]+", text.lower())
            hashes = [int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") for word in words]
            for h in hashes:
                row[h % self.dimension] += 1 if h >> 63 else -1
            if not row.any():
                for h in hashes:
                    row[h % self.dimension] += 1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0)


@dataclass(frozen=True)
class GazetteerExtractor:
    """Known names, each with its kind; whole words in any case, in the order of their places."""

    names: tuple[tuple[str, str], ...] = ()
    score: float = 0.9

    def extract(self, texts: Sequence[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            found = []
            for name, kind in self.names:
                if m := re.search(r"(?<!\w)" + re.escape(name) + r"(?!\w)", text, re.IGNORECASE):
                    found.append((m.start(), {"text": name, "label": kind, "score": self.score}))
            out.append([e for _, e in sorted(found, key=lambda x: x[0])])
        return out


@dataclass(frozen=True)
class ExtractiveGenerator:
    """The first sentences of what the prompt gives as context."""

    sentences: int = 3

    def generate(self, prompt: str) -> str:
        lines = [x.split(": ", 1)[1] for x in prompt.splitlines() if x.startswith(("Community: ", "Note: ")) and ": " in x]
        return " ".join(re.split(r"(?<=[.!?])\s+", " ".join(lines))[: self.sentences])


def retried(f: Callable[[], T], attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """f(), again after 2, 4, ... seconds if it raises; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return f()
        except Exception:
            if k == attempts:
                raise
            sleep(base**k)
    raise AssertionError


def checked(embedder: Embedder, text: str = "check") -> str | None:
    """What is wrong with an embedder, or None: it has to answer, with one finite vector of its dimension."""
    try:
        found = np.asarray(embedder.embed([text]), dtype=np.float64)
    except Exception as error:  # noqa: BLE001
        return f"the embedder does not answer: {error}"
    if found.shape != (1, embedder.dimension):
        return f"the embedder gave {found.shape}, not a vector of {embedder.dimension}"
    return None if np.isfinite(found).all() else "the embedder gave numbers that are not finite"


def cleaned(found: list[dict], least: float = 0.5) -> list[dict]:
    """Entities with a label and a score of `least` or more (missing: 0.5), the first of each label in any case; kind `concept` if missing."""
    out, seen = [], set()
    for e in found:
        label = str(e.get("text") or e.get("name") or "").strip()
        score = e.get("score")
        score = 0.5 if score is None else float(score)
        if label and score >= least and label.lower() not in seen:
            seen.add(label.lower())
            out.append({"id": slug(label), "label": label, "type": str(e.get("label") or e.get("type") or "concept"), "score": score})
    return out
