"""Agreement of two annotators on spans."""

from __future__ import annotations

import numpy as np


def matches(a: np.ndarray, b: np.ndarray, strict: bool = False) -> int:
    """How many rows of a, taken by (start, end), find a partner among the rows of b that are still free.

    Partners overlap by half of either span (strict: of both), and of several the least by (start, end) is taken. For a
    span only a stretch of b comes into question: from where ends reach past its start to where starts pass its end.
    """
    a, b = (x[np.lexsort((x[:, 1], x[:, 0]))] for x in (a, b))
    reach = np.maximum.accumulate(b[:, 1]) if len(b) else b[:, 1]
    low, high = np.searchsorted(reach, a[:, 0], "right"), np.searchsorted(b[:, 0], a[:, 1], "left")
    free = np.ones(len(b), bool)
    found = 0
    for (start, end), lo, hi in zip(a, low, high, strict=True):
        near = b[lo:hi]
        common = np.minimum(near[:, 1], end) - np.maximum(near[:, 0], start)
        of_a, of_b = 2 * common >= end - start, 2 * common >= near[:, 1] - near[:, 0]
        good = np.flatnonzero(free[lo:hi] & (common > 0) & (of_a & of_b if strict else of_a | of_b))
        if len(good):
            free[lo + good[0]] = False
            found += 1
    return found


def span_f1(a: list[tuple[int, int]], b: list[tuple[int, int]], strict: bool = False) -> float | None:
    """F1 of the matching; None where neither annotator has a span."""
    both = [np.array(x, np.int64).reshape(-1, 2) for x in (a, b)]
    total = len(a) + len(b)
    return 2 * matches(*both, strict) / total if total else None
