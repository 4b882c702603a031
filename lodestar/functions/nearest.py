"""The best vectors for many probes: matrix products in Arrow batches.

A product of two blocks (single precision, vectors of length one; double where that
leaves many pairs) only tells which pairs may be among a probe's best. These are
scored again by one dot product each, summed from the first element on, over the root
of the product of the two sums of squares, so a score depends on its two vectors alone
and equal vectors tie exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a batch's vectors that are held at a time, and sides of a block of products.
HELD_NUMBERS, PROBE_SIDE, ROW_SIDE = 1 << 20, 256, 1024
#: Pairs that are scored again at a time, and pairs that wait for it at least before lists and floors are brought up to date.
PAIRS, WAITING = 1 << 11, 1 << 16
#: A block of which single precision leaves more than one pair in so many is multiplied again in double precision.
DENSE = 16
#: Sums of squares outside of this are no base of an estimate: such vectors are always scored in full.
LEAST, MOST = 1e-140, 1e140


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors with ``width`` elements, none of them null, and their elements."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(places)).flatten()
    if flat.null_count:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
        places, flat = places[whole], flat.filter(pa.array(np.repeat(whole, width)))
    return places, flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def _sum(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, element after element."""
    return np.cumsum(products, axis=1)[:, -1]


class Side:
    """Vectors that have a direction: elements, sums of squares, unit vectors (not a number where they can't be told)."""

    def __init__(self, column: pa.Array, width: int):
        places, elements = vectors_of(column, width)
        squares = _sum(elements * elements) if len(elements) else np.zeros(0)
        some = ~(squares <= 0)
        self.places, self.elements, self.squares = places[some], elements[some], squares[some]
        sound = (self.squares > LEAST) & (self.squares < MOST)
        self.units = self.elements / np.sqrt(np.where(sound, self.squares, np.nan))[:, None]
        self.coarse = self.units.astype(np.float32)

    def only(self, kept: np.ndarray) -> None:
        self.places, self.elements, self.squares, self.units, self.coarse = (x[kept] for x in (self.places, self.elements, self.squares, self.units, self.coarse))


def _best(probe: np.ndarray, score: np.ndarray, order: np.ndarray, top_k: int) -> np.ndarray:
    """The places of each probe's first ``top_k``, by score (not a number is the greatest), then order."""
    by = np.lexsort((order, -np.where(np.isnan(score), np.inf, score), probe))  # no score is infinite
    starts = np.flatnonzero(np.r_[True, probe[by][1:] != probe[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[nth < top_k]


def _ranks(keys: pa.Array) -> np.ndarray:
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


class Nearest:
    """The best ``top_k`` keys of each of a block of probes among the vectors seen so far."""

    def __init__(self, probes: pa.Array, width: int, top_k: int):
        self.asked, self.width, self.top_k = Side(probes, width), width, top_k
        n = len(self.asked.places)
        self.floor = np.full(n, -np.inf)  # an estimate below it can't be among the best
        self.margin = 1e-15 * (4 * width + 16)  # over twice the largest error of an estimate and a score
        self.wide = 2.0**-23 * (width + 4)  # over the largest error of an estimate in single precision
        self.made = np.empty(PROBE_SIDE * ROW_SIDE, np.float32)
        self.probe, self.score, self.keys = np.zeros(0, np.int64), np.zeros(0), None

    def see(self, keys: pa.Array, column: pa.Array) -> None:
        each = max(1, HELD_NUMBERS // self.width)
        for at in range(0, len(keys), each):
            self._see(keys.slice(at, each), column.slice(at, each))

    def _see(self, keys: pa.Array, column: pa.Array) -> None:
        rows = Side(column, self.width)
        if not len(rows.places) or not len(self.asked.places):
            return
        order = _ranks(keys.take(pa.array(rows.places)))
        _, same = np.unique(np.ascontiguousarray(rows.elements).view(f"V{8 * self.width}").ravel(), return_inverse=True)
        rows.only(np.sort(_best(same.ravel(), np.zeros(len(same)), order, self.top_k)))  # of equal vectors the first keys come before all others
        found, waiting = [], 0
        for b in range(0, len(rows.places), ROW_SIDE):
            for a in range(0, len(self.asked.places), PROBE_SIDE):
                found.append(self._block(a, b, rows))
                waiting += len(found[-1][0])
                if waiting >= max(WAITING, self.top_k * len(self.floor)):
                    self._take(found, keys, rows)
                    found, waiting = [], 0
        if waiting:
            self._take(found, keys, rows)

    def _block(self, a: int, b: int, rows: Side) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block that may be among the best."""
        probes, others, floor = self.asked.coarse[a : a + PROBE_SIDE], rows.coarse[b : b + ROW_SIDE], self.floor[a : a + PROBE_SIDE]
        made = np.matmul(probes, others.T, out=self.made[: len(probes) * len(others)].reshape(len(probes), len(others)))
        fresh = np.flatnonzero(floor == -np.inf)
        if len(fresh) and len(others) >= self.top_k:
            known = np.where(np.isnan(made[fresh]), -np.inf, made[fresh])  # what can't be estimated may score anything
            floor[fresh] = np.partition(known, len(others) - self.top_k, axis=1)[:, len(others) - self.top_k].astype(np.float64) - self.wide - self.margin
        low = np.nextafter((floor - self.wide).astype(np.float32), np.float32(-np.inf))
        some = np.flatnonzero(~(made.max(axis=1) < low))  # most probes have none; the greatest is no number if one is none
        kept = ~(made[some] < low[some, None])
        if np.count_nonzero(kept) > made.size // DENSE:
            kept &= ~(self.asked.units[a : a + PROBE_SIDE][some] @ rows.units[b : b + ROW_SIDE].T < floor[some, None])
        probe, row = np.divmod(np.flatnonzero(kept), len(others))
        return some[probe] + a, row + b

    def _take(self, found: list[tuple[np.ndarray, np.ndarray]], keys: pa.Array, rows: Side) -> None:
        probe, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        self._merge(probe, self._scores(probe, row, rows), keys.take(pa.array(rows.places[row])))

    def _scores(self, probe: np.ndarray, row: np.ndarray, rows: Side) -> np.ndarray:
        out = np.empty(len(probe))
        with np.errstate(all="ignore"):
            for at in range(0, len(probe), PAIRS):
                p, r = probe[at : at + PAIRS], row[at : at + PAIRS]
                out[at : at + PAIRS] = _sum(rows.elements[r] * self.asked.elements[p]) / np.sqrt(rows.squares[r] * self.asked.squares[p])
        return np.clip(out, -1.0, 1.0)

    def _merge(self, probe: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        if self.keys is not None:
            probe, score, keys = np.r_[self.probe, probe], np.r_[self.score, score], pa.concat_arrays([self.keys, keys])
        kept = _best(probe, score, _ranks(keys), self.top_k)
        self.probe, self.score, self.keys = probe[kept], score[kept], keys.take(pa.array(kept))
        last = np.flatnonzero(np.r_[self.probe[1:] != self.probe[:-1], True])
        full = last[np.bincount(self.probe, minlength=len(self.floor))[self.probe[last]] == self.top_k]
        kth = self.score[full]
        # a list that is full of what is no number is only entered by such
        self.floor[self.probe[full]] = np.maximum(self.floor[self.probe[full]], np.where(np.isnan(kth), np.inf, kth - self.margin))


def nearest(batches: Iterator[pa.RecordBatch], qids: pa.Array, probes: pa.Array, top_k: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """qid, key and score of the best ``top_k`` of each probe among batches of keys and vectors."""
    widths = np.unique(pc.fill_null(pc.list_value_length(probes), 0).to_numpy(zero_copy_only=False))
    seen = [Nearest(probes, int(w), top_k) for w in widths if w > 0]
    for batch in batches:
        for own in seen:
            own.see(batch.column(0), batch.column(1))
    for own in seen:
        if own.keys is not None:
            yield qids.take(pa.array(own.asked.places[own.probe])), own.keys, pa.array(own.score)
