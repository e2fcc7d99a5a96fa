"""Scorers: anything that gives a row of label probabilities per text. Models plug in here."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    labels: list[str]

    def score(self, texts: list[str]) -> np.ndarray: ...


class KeywordScorer:
    """A deterministic stand-in: the share of a label's keywords that a text contains, plus a small hash term."""

    def __init__(self, keywords: dict[str, list[str]]) -> None:
        self.labels, self.keywords = sorted(keywords), keywords

    def score(self, texts: list[str]) -> np.ndarray:
        rows = []
        for t in texts:
            low = t.lower()
            noise = zlib.crc32(low.encode()) % 1000 / 10_000
            rows.append([min(1.0, sum(k in low for k in self.keywords[x]) / len(self.keywords[x]) * 0.9 + noise) for x in self.labels])
        return np.array(rows, dtype=float).reshape(len(texts), len(self.labels))


def probabilities(scorer: Scorer) -> Callable[[Column], Column]:
    """A column function text -> array<double> in the order of scorer.labels; batches reach the scorer sorted by length."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        filled = texts.fillna("")
        order = filled.str.len().to_numpy().argsort(kind="stable")
        out: list = [None] * len(filled)
        for i, row in zip(order, scorer.score([filled.iloc[i] for i in order]), strict=True):
            out[i] = row.tolist()
        return pd.Series(out)

    return run


class Registry:
    """Named loaders; one that fails is kept with its reason and doesn't stop the others."""

    def __init__(self) -> None:
        self.loaded: dict[str, Scorer] = {}
        self.failed: dict[str, str] = {}

    def load(self, name: str, loader: Callable[[], Scorer]) -> None:
        try:
            self.loaded[name] = loader()
        except Exception as e:  # noqa: BLE001  a loader may fail in any way
            self.failed[name] = f"{type(e).__name__}: {e}"
