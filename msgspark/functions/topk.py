"""Per-task top-k by cosine: one matrix product per batch of rows.

Small helper for the retrieval operators. Spark splits and shuffles the rows;
a task only ever holds one batch of them and the best k per question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROWS = 2048
QUESTIONS = 2048
DIGITS = 6


def dense_rows(column: pa.Array) -> np.ndarray:
    """Arrow list column of equal-length vectors to a float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim, rest = divmod(len(values), len(column))
    if rest or (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError("vectors must be present and of one length")
    return values.reshape(len(column), dim)


def sparse_rows(buckets: pa.Array, weights: pa.Array, dim: int) -> np.ndarray:
    """Arrow sparse vectors to a float64 matrix."""
    out = np.zeros((len(buckets), dim))
    sizes = np.diff(buckets.offsets.to_numpy())
    rows = np.repeat(np.arange(len(buckets)), sizes)
    out[rows, buckets.flatten().to_numpy()] = weights.flatten().to_numpy()
    return out


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in place; rows without one are zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    flat = ~(norms > 0)
    norms[flat] = 1
    matrix /= norms[:, None]
    matrix[flat] = 0
    return matrix


def by_cell(cells: pa.ListArray) -> dict[str, np.ndarray]:
    """For every cell which rows name it; a byte each, however many cells a row has."""
    rows = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    coded = cells.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    out = {name: np.zeros(len(cells), dtype=bool) for name in coded.dictionary.to_pylist()}
    for k, asked in enumerate(out.values()):
        asked[rows[at == k]] = True
    return out


class Best:
    """Best ``k`` rows per question: higher rounded score first, then smaller id.

    ``wanted`` marks the questions of each cell; rows without any of them are no hits.
    """

    def __init__(self, questions: np.ndarray, k: int, wanted: dict[str, np.ndarray] | None = None):
        self.questions = questions
        self.k = k
        self.by_cell = wanted
        self.rows: list[list[tuple[float, str]]] = [[] for _ in questions]
        self.floor = np.full(len(questions), -np.inf)  # score of the k-th row so far

    def add(
        self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray | None = None, sets: np.ndarray | None = None
    ) -> None:
        """``cells`` are those of the rows, one column for each set of cells; with ``sets`` a
        row is there for the cell of that set only, and comes again for its others."""
        if self.by_cell is None or cells is None:
            self._add(ids, vectors, np.arange(len(self.questions)))
            return
        cells = np.array([c if isinstance(c, list) else [c] for c in cells], dtype=object).reshape(len(ids), -1)
        nobody = np.zeros(len(self.questions), dtype=bool)
        for n in range(cells.shape[1]):
            there = np.ones(len(ids), dtype=bool) if sets is None else sets == n
            for cell in np.unique(cells[there, n]):
                if cell in self.by_cell:
                    own = there & (cells[:, n] == cell)
                    asked = np.flatnonzero(self.by_cell[cell])
                    met = np.zeros((int(own.sum()), len(asked)), dtype=bool)
                    for before in cells[own, :n].T:
                        met |= np.stack([self.by_cell.get(c, nobody)[asked] for c in before])
                    self._add(ids[own], vectors[own], asked, met)

    def _add(
        self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, met: np.ndarray | None = None
    ) -> None:
        """``met`` marks the pairs of rows and questions that an earlier set of cells brought."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        for first in range(0, len(asked), QUESTIONS):
            own = asked[first : first + QUESTIONS]
            scores = np.round(vectors @ self.questions[own].T, DIGITS) + 0.0
            if met is not None:
                scores[met[order, first : first + QUESTIONS]] = -np.inf
            # after a few batches most questions have nothing to gain from a batch
            for j in np.flatnonzero(scores.max(axis=0) >= self.floor[own]):
                self._merge(own[j], ids, scores[:, j])

    def _merge(self, question: int, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor[question]
        if len(ids) > self.k:
            floor = max(floor, -np.partition(-scores, self.k - 1)[self.k - 1])
        rows = np.flatnonzero((scores >= floor) & (scores > -np.inf))
        rows = rows[np.argsort(-scores[rows], kind="stable")][: self.k]
        found = [(-float(scores[r]), str(ids[r])) for r in rows]
        best = sorted(self.rows[question] + found)[: self.k]
        self.rows[question] = best
        if len(best) == self.k:
            self.floor[question] = -best[-1][0]

    def table(self, query_ids: list, schema: pa.Schema) -> pa.RecordBatch:
        hits = [(q, i, -s) for q, row in zip(query_ids, self.rows) for s, i in row]
        columns = list(zip(*hits)) if hits else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )
