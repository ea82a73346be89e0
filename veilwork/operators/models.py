"""Model detectors: anything that names spans in texts, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import spans as S


class Model(Protocol):
    """find() gives (start, end, type, confidence) of each span of a text."""

    def find(self, text: str, labels: list[str]) -> list[tuple[int, int, str, float]]: ...


def detector(load: Callable[[], Model], least: float = 0.5) -> Callable[[Column, list[str] | None], Column]:
    """A detector for policies and the staged pipeline. load() runs once in each Python worker's task."""

    def detect(text: Column, labels: list[str] | None = None) -> Column:
        wanted = list(labels or [])

        @F.pandas_udf(S.SPANS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([_spans(model.find(t or "", wanted), least) for t in texts])

        return run(text)

    return detect


def _spans(found: list[tuple[int, int, str, float]], least: float) -> list[dict]:
    kept = sorted((s for s in found if s[3] >= least), key=lambda s: (s[0], s[1]))
    return [{"start": a, "end": b, "type": kind.upper(), "confidence": float(c)} for a, b, kind, c in kept]


class Words:
    """A stand-in for a model: names given words, with given confidence. Deterministic, for tests and dry runs."""

    def __init__(self, words: dict[str, tuple[str, float]]):
        self.words = words

    def find(self, text: str, labels: list[str]) -> list[tuple[int, int, str, float]]:
        out = []
        for word, (kind, confidence) in self.words.items():
            at = text.find(word)
            while at >= 0:
                if not labels or kind in labels:
                    out.append((at, at + len(word), kind, confidence))
                at = text.find(word, at + 1)
        return out


def resolve(registry: dict[str, Callable], name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"unknown detector {name!r}; there are {sorted(registry)}")
    return registry[name]
