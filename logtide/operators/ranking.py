"""NumPy helpers for ranking by cosine, used inside tasks."""

from __future__ import annotations

import numpy as np

DIGITS = 9
_CELLS = 4_000_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosines are 0."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def top_k(queries: np.ndarray, table: np.ndarray, names: np.ndarray, k: int,
          skip: np.ndarray | None = None):
    """Yield ``(row, positions, similarities, ranks)`` of the best ``k`` rows of ``table``.

    ``ranks`` are the similarities to ``DIGITS`` places, which is what the order goes by;
    ``table`` is in order of ``names``, which settles ties. ``skip`` holds for each query a
    name to leave out. Works through the queries in blocks of bounded memory.
    """
    step = max(1, _CELLS // max(1, len(table)))
    for lo in range(0, len(queries), step):
        sims = queries[lo:lo + step] @ table.T
        # + 0.0 turns -0.0 into 0.0, so that both count as equal everywhere.
        for i, row in enumerate(np.round(sims, DIGITS) + 0.0):
            if skip is not None:
                row = np.where(names == skip[lo + i], -np.inf, row)
            if len(row) > k:
                limit = -np.partition(-row, k - 1)[k - 1]
                candidates = np.flatnonzero(row >= limit)
            else:
                candidates = np.arange(len(row))
            best = candidates[np.argsort(-row[candidates], kind="stable")[:k]]
            best = best[np.isfinite(row[best])]
            yield lo + i, best, sims[i][best], row[best]
