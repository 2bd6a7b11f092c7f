"""Weighted one-to-one matching of facts: maximum total similarity first, then the threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total score, by shortest augmenting paths with dual prices."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    price_row, price_col = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = owner[at]
            slack = cost[row - 1] - price_row[row] - price_col[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            nxt = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[nxt]
            price_row[owner[used]] += delta
            price_col[used] -= delta
            least[~used] -= delta
            at = nxt
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[came[at]], came[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def match_weighted(scores: DataFrame, key: str, threshold: float, *, band: float = 0.1) -> DataFrame:
    """tp, fp, fn, in_review (matches within ``band`` above the threshold) by case.

    ``scores``: one row per case with ``similarity``, an array of rows (predicted) of columns (reference). A case is
    one small matrix; cases are spread over tasks.
    """
    kind = scores.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, matrix in zip(pdf[key], pdf["similarity"], strict=True):
                m = np.array([np.asarray(r, float) for r in matrix]) if len(matrix) else np.zeros((0, 0))
                found = [m[p] for p in best_assignment(m) if m[p] >= threshold] if m.size else []
                columns = m.shape[1] if m.ndim == 2 else 0
                rows.append((k, len(found), len(matrix) - len(found), columns - len(found), sum(v < threshold + band for v in found)))
            yield pd.DataFrame(rows, columns=[key, "tp", "fp", "fn", "in_review"])

    return scores.select(key, "similarity").mapInPandas(run, f"{key} {kind}, tp long, fp long, fn long, in_review long")
