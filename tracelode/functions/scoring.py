"""Scores of many queries over batches of documents: rough ones as products of narrow matrices of single floats, exact ones only for pairs that can be among the first k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracelode.functions.embedding import hashed_counts

K1, B = 1.2, 0.75
DIGITS = 6
#: Queries whose scores for a batch are in memory at a time.
BLOCK = 512
#: A term is a column of the product where its postings would cost more: of a share of documents times users, and columns of a block at most.
DENSE_USE, DENSE_MOST = 2.5, 1024
#: Pairs whose vectors are compared exactly at a time.
PAIRS = 4096
#: Scores that a task keeps at most to know its bounds.
KEPT_SCORES = 1 << 22
#: Half of the last digit, and what single floats may be off in a product of unit vectors, with room to spare.
HALF, UNIT_ERROR = 1e-6, 5e-5
#: Relative error of a sum of single floats for each term, with room to spare.
SUM_ERROR = 2.5e-7


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def blocks_in_order(*keys: np.ndarray) -> list[np.ndarray]:
    """Places of queries dealt into blocks, those of like keys together; the first key decides first."""
    order = np.lexsort(keys[::-1])
    return [order[i : i + BLOCK] for i in range(0, len(order), BLOCK)]


class Tops:
    """For each block of queries and value of the parts the k greatest scores of each query so far, and so the least that still counts."""

    def __init__(self, k: int, floor: list[np.ndarray] | None = None):
        self.k, self.floor, self.known, self.size = k, floor, {}, 0

    def bound(self, block: int, value: tuple, n: int) -> np.ndarray:
        known = self.known.get((block, value))
        least = np.full(n, -np.inf) if known is None else known[:, 0]
        return least if self.floor is None else np.maximum(least, self.floor[block])

    def add(self, block: int, value: tuple, n: int, column: np.ndarray, score: np.ndarray) -> None:
        """score: of a column's rows, each row once."""
        known = self.known.get((block, value))
        if known is None:
            if self.size + n * self.k > KEPT_SCORES:
                return
            self.size += n * self.k
            known = self.known[block, value] = np.full((n, self.k), -np.inf)
        order = np.lexsort((-score, column))
        column, score = column[order], score[order]
        own, first = np.unique(column, return_index=True)
        nth = np.arange(len(column)) - np.repeat(first, np.diff(np.append(first, len(column))))
        fresh = np.full((len(own), self.k), -np.inf)
        kept = nth < self.k
        fresh[np.searchsorted(own, column[kept]), nth[kept]] = score[kept]
        both = np.partition(np.concatenate([known[own], fresh], axis=1), self.k, axis=1)[:, self.k :]
        # The least of the k stands first.
        least = both.argmin(axis=1)
        both[np.arange(len(own)), least], both[:, 0] = both[:, 0].copy(), both[np.arange(len(own)), least].copy()
        known[own] = both


class TermBlocks:
    """BM25 of blocks of queries, each a list of places in a vocabulary. Batches: ..., length, terms, counts."""

    def __init__(self, blocks: list[np.ndarray], asked: list[np.ndarray], idf: np.ndarray, mean: float, share: np.ndarray):
        """share: of each term, the share of documents that have it."""
        self.blocks, self.idf, self.mean = blocks, idf, mean
        self.parts = []
        for block in blocks:
            terms = np.concatenate([asked[q] for q in block]).astype(np.int32)
            column = np.repeat(np.arange(len(block), dtype=np.int32), [len(asked[q]) for q in block])
            order = np.argsort(terms, kind="stable")
            own, first = np.unique(terms[order], return_index=True)
            starts = np.append(first, len(terms)).astype(np.int64)
            use = share[own] * np.diff(starts)
            wide = np.flatnonzero(use > DENSE_USE)
            wide = np.sort(wide[np.argsort(-use[wide], kind="stable")][:DENSE_MOST])
            self.parts.append((own, starts, column[order], wide, max(len(asked[q]) for q in block)))

    def task(self) -> Callable[[pa.RecordBatch], TermBatch]:
        scratch = np.full(len(self.idf), -1, np.int32)
        made = []
        for block, (own, starts, column, wide, longest) in zip(self.blocks, self.parts, strict=True):
            place = np.full(len(own), -1, np.int32)
            place[wide] = np.arange(len(wide))
            matrix = np.zeros((len(wide), len(block)), np.float32)
            uses = np.diff(starts)
            is_wide = np.repeat(place, uses)
            matrix[is_wide[is_wide >= 0], column[is_wide >= 0]] = 1
            made.append((own, starts, column, place, matrix, 1 + SUM_ERROR * (longest + 8)))
        return lambda batch: TermBatch(self, made, scratch, batch)


class TermBatch:
    def __init__(self, whole: TermBlocks, made: list, scratch: np.ndarray, batch: pa.RecordBatch):
        self.made, self.scratch, self.n = made, scratch, batch.num_rows
        length, lists, counts = batch.columns[-3:]
        self.term = lists.flatten().to_numpy().astype(np.int64)
        tf = counts.flatten().to_numpy().astype(float)
        self.row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        size = length.to_numpy().astype(float)[self.row]
        self.weight = whole.idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / whole.mean))

    def rough(self, n: int, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows in which a query of the block can reach the least score, and their scores in single floats."""
        own, starts, column, place, matrix, error = self.made[n]
        self.scratch[own] = np.arange(len(own), dtype=np.int32)
        local = self.scratch[self.term]
        self.scratch[own] = -1
        at = np.flatnonzero(local >= 0)
        local, row, weight = local[at], self.row[at], self.weight[at]
        self.used = local, row, weight
        # No query of the block has more than all of a row's terms that any of them has.
        most = np.bincount(row, weight, self.n)[rows]
        rows = rows[(most > 0) & (most * error + HALF >= least)]
        if not len(rows):
            return rows, np.zeros((0, matrix.shape[1]), np.float32)
        to = np.full(self.n, -1, np.int64)
        to[rows] = np.arange(len(rows))
        row = to[row]
        kept = row >= 0
        local, row, weight = local[kept], row[kept], weight[kept].astype(np.float32)
        wide = place[local]
        is_wide = wide >= 0
        left = np.zeros((len(rows), len(matrix)), np.float32)
        left[row[is_wide], wide[is_wide]] = weight[is_wide]
        scores = left @ matrix
        local, row, weight = local[~is_wide], row[~is_wide], weight[~is_wide]
        times = starts[local + 1] - starts[local]
        first = np.repeat(starts[local] - np.concatenate(([0], np.cumsum(times)[:-1])) if len(local) else starts[:0], times)
        users = column[first + np.arange(int(times.sum()))]
        np.add.at(scores.reshape(-1), np.repeat(row, times) * matrix.shape[1] + users, np.repeat(weight, times))
        return rows, scores

    def reach(self, n: int, bound: np.ndarray) -> np.ndarray:
        """A rough score below it can't be one of the bound or more."""
        return (np.maximum(bound - HALF, 0) / self.made[n][-1]).astype(np.float32) * np.float32(1 - 1e-6)

    def sure(self, n: int, rough: np.ndarray) -> np.ndarray:
        """What the exact score of a rough one is at least."""
        return rough.astype(float) / self.made[n][-1] - HALF

    def exact(self, n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Scores of pairs of rows and columns; after rough of the block."""
        own, starts, column, _, matrix, _ = self.made[n]
        local, row, weight = self.used
        has = np.zeros((len(own), matrix.shape[1]), bool)
        has[np.repeat(np.arange(len(own)), np.diff(starts)), column] = True
        ends = np.searchsorted(row, np.arange(self.n + 1))
        times = (ends[1:] - ends[:-1])[rows]
        pair = np.repeat(np.arange(len(rows)), times)
        at = np.repeat(ends[rows] - np.concatenate(([0], np.cumsum(times)[:-1])) if len(rows) else ends[:0], times) + np.arange(int(times.sum()))
        return np.bincount(pair, weight[at] * has[local[at], columns[pair]], len(rows))


class HashedBlocks:
    """Cosines of blocks of queries with the hashing embeddings of texts, a batch's last column."""

    def __init__(self, blocks: list[np.ndarray], counts: np.ndarray):
        """counts: a row for each query, see hashed_counts."""
        self.blocks, self.counts = blocks, counts

    def task(self) -> Callable[[pa.RecordBatch], HashedBatch]:
        made = []
        for block in self.blocks:
            q = self.counts[block].astype(float)
            norm = np.sqrt((q * q).sum(axis=1))
            unit = np.divide(q, norm[:, None], out=np.zeros_like(q), where=norm[:, None] > 0).astype(np.float32)
            made.append((q.astype(np.float32), norm, np.ascontiguousarray(unit.T)))
        return lambda batch: HashedBatch(made, self.counts.shape[1], batch)


class HashedBatch:
    def __init__(self, made: list, dimension: int, batch: pa.RecordBatch):
        self.made = made
        self.d = hashed_counts(batch.column(batch.num_columns - 1), dimension)
        self.norm = np.sqrt((self.d * self.d).sum(axis=1))
        self.unit = np.divide(self.d, self.norm[:, None], out=np.zeros_like(self.d), where=self.norm[:, None] > 0).astype(np.float32)

    def rough(self, n: int, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.norm[rows] > 0]
        return rows, self.unit[rows] @ self.made[n][2]

    def reach(self, n: int, bound: np.ndarray) -> np.ndarray:
        return (bound - UNIT_ERROR).astype(np.float32)

    def sure(self, n: int, rough: np.ndarray) -> np.ndarray:
        return rough.astype(float) - UNIT_ERROR

    def exact(self, n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        q, norm, _ = self.made[n]
        out = np.zeros(len(rows))
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at : at + PAIRS], columns[at : at + PAIRS]
            of = self.norm[r] * norm[c]
            out[at : at + PAIRS] = np.divide(np.einsum("ij,ij->i", self.d[r], q[c].astype(float)), of, out=np.zeros(len(r)), where=of > 0)
        return out


def candidates(blocks: list[np.ndarray], opened: TermBatch | HashedBatch, groups: list[tuple[tuple, np.ndarray]], tops: Tops) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, queries, exact scores) of a batch, for each block and group: all pairs above 0 that k others of their query and group, as far as tops knows, don't exceed."""
    for n, block in enumerate(blocks):
        for value, rows in groups:
            bound = tops.bound(n, value, len(block))
            rows, rough = opened.rough(n, rows, bound.min())
            if not len(rows):
                continue
            chosen = rough >= np.maximum(opened.reach(n, bound), np.float32(HALF / 4))
            count = np.count_nonzero(chosen)
            if len(rows) > tops.k and count > 2 * tops.k * len(block):
                kth = np.partition(rough, len(rows) - tops.k, axis=0)[len(rows) - tops.k]
                bound = np.maximum(bound, rounded(opened.sure(n, kth)))
                chosen &= rough >= opened.reach(n, bound)
            flat = np.flatnonzero(chosen)
            if not len(flat):
                continue
            row, column = rows[flat // len(block)], flat % len(block)
            score = rounded(opened.exact(n, row, column))
            good = (score > 0) & (score >= bound[column])
            row, column, score = row[good], column[good], score[good]
            if len(row):
                tops.add(n, value, len(block), column, score)
                yield row, block[column], score
