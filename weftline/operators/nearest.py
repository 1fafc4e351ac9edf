"""Array parts of the retrievers: lists of lists as flat arrays, their sums, and the best rows of each column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftline.functions.text import word_ngrams


class Ragged:
    """Lists of small numbers: ``flat`` holds them one after another, list i has ``lens[i]`` from ``starts[i]`` on."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        self.flat, self.lens, self.starts = flat, lens, np.cumsum(lens) - lens

    def inside(self, other: Ragged) -> Ragged:
        """Each number replaced by its list in other."""
        lens = other.lens[self.flat]
        at = np.repeat(other.starts[self.flat] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return Ragged(other.flat[at], np.bincount(self.owner(), lens, len(self.lens)).astype(np.int64))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def part(self, a: int, b: int) -> Ragged:
        return Ragged(self.flat[self.starts[a] : self.starts[a] + self.lens[a:b].sum()] if a < len(self.lens) else self.flat[:0], self.lens[a:b])

    def sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, for the lists in that order the sum of table's rows at their numbers); order is by falling length."""
        order = np.argsort(-self.lens, kind="stable")
        lens, starts = self.lens[order], self.starts[order]
        out = np.zeros((len(order), table.shape[1]))
        for j in range(int(lens[0]) if len(lens) else 0):
            n = int(np.searchsorted(-lens, -j, "left"))  # lists longer than j
            out[:n] += table[self.flat[starts[:n] + j]]
        return order, out


def words(column: pa.ChunkedArray) -> tuple[list[str], Ragged]:
    """(distinct words, the rows' words as numbers among them)."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), Ragged(coded.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64))


def spelled(vocabulary: list[str], known: dict[str, int]) -> Ragged:
    """The grams of each word as numbers, those known only."""
    found = [[known[g] for g in word_ngrams(w) if g in known] for w in vocabulary]
    return Ragged(np.array([g for f in found for g in f], np.int64), np.array([len(f) for f in found], np.int64))


def gram_sets(rows: Ragged, grams: Ragged, many: int, chunk: int = 4096):
    """(first row, row in the chunk, gram, count) of the rows' distinct grams, a chunk of rows at a time."""
    for a in range(0, len(rows.lens), chunk):
        some = rows.part(a, a + chunk).inside(grams)
        pairs, counts = np.unique(some.owner() * many + some.flat, return_counts=True)
        yield a, pairs // many, pairs % many, counts


class Best:
    """The k rows of the best scores, rounded to ``digits``, of each column; among equal ones the smaller row. Rows come in rising order."""

    def __init__(self, columns: int, k: int, digits: int, least: float):
        self.k, self.digits, self.least = k, digits, least
        self.score, self.row, self.floor = np.full((columns, k), -np.inf), np.full((columns, k), -1), np.full(columns, least)

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """scores: a line per row. A score counts only above ``least``."""
        over = scores > self.floor
        if np.count_nonzero(over) > 4 * self.k * scores.shape[1] and len(scores) > self.k:
            over &= scores >= np.partition(scores, -self.k, axis=0)[-self.k] - 10.0**-self.digits  # k others are better, even rounded
        r, c = np.nonzero(over)
        self.put(rows[r], c, scores[r, c])

    def put(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray) -> None:
        """Single scores above the floors of their columns."""
        if not len(rows):
            return
        some = np.unique(columns)
        column = np.concatenate([np.repeat(some, self.k), columns])
        score = np.concatenate([self.score[some].ravel(), np.round(scores, self.digits)])
        row = np.concatenate([self.row[some].ravel(), rows])
        order = np.lexsort((row, -score, column))
        column = column[order]
        kept = order[np.arange(len(order)) - np.searchsorted(column, column) < self.k]
        self.score[some], self.row[some] = score[kept].reshape(-1, self.k), row[kept].reshape(-1, self.k)
        # Later rows lose ties, so they must round to more than the k-th score.
        self.floor[some] = np.maximum(self.least, self.score[some, -1] + 0.5 * 10.0**-self.digits - 1e-9)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, row, score)"""
        there = np.isfinite(self.score)
        return np.nonzero(there)[0], self.row[there], self.score[there]
