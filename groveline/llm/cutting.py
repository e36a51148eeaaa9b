"""Cutting texts into sentences and hashing runs of them, with numpy, inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = 0x9E3779B97F4A7C15
_MARKS = ".!?,;:"
_TABLES: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """For every code point: 1 blank, 2 a mark that ends a unit, 3 a line break; else 0."""
    if "kinds" not in _TABLES:
        kinds = np.zeros(0x110000, dtype=np.uint8)
        kinds[[c for c in range(0x3001) if chr(c).isspace()]] = 1
        kinds[[ord(c) for c in _MARKS]] = 2
        kinds[ord("\n")] = 3
        _TABLES["kinds"] = kinds
    return _TABLES["kinds"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, modulo 2^64, of the base and of its inverse."""
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 14), base, dtype=np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run values[first:end] its polynomial modulo 2^64, mixed."""
    up, down = _powers(len(values) + 1)
    totals = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=totals[1:])
    return mixed((totals[end] - totals[first]) * down[first])


def _lowered(text: str) -> str:
    """In lower case, character by character where the whole would change its length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _unit_starts(kinds: np.ndarray) -> np.ndarray:
    """Where the sentences and clauses of a text start, as places.

    A unit is a stretch without marks and line breaks, the marks after it and one line
    break. What follows of marks and line breaks is a unit of its own.
    """
    ends = kinds >= 2
    after = np.nonzero(ends[:-1] & ~ends[1:])[0] + 1
    breaks = np.nonzero(kinds == 3)[0]
    if len(breaks):
        run = np.nonzero(ends & ~np.concatenate([[False], ends[:-1]]))[0]
        begin = run[np.searchsorted(run, breaks, "right") - 1]
        before = np.concatenate([[-1], breaks[:-1]])
        breaks = breaks[(before < begin) & (begin > 0) & (breaks + 1 < len(kinds))] + 1
        breaks = breaks[ends[breaks]]
    return np.unique(np.concatenate([[0], after, breaks]))


def _least_in_windows(hashes: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """For windows that start at ``window`` the place of the least hash, the last of equal ones."""
    place = window + (width - 1)
    least = hashes[place]
    for k in range(width - 2, -1, -1):
        other = hashes[window + k]
        less = other < least
        least = np.where(less, other, least)
        place = np.where(less, window + k, place)
    return place


def cut(text: str, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, first, hashes): where units start, and the end of the text; the first word of
    each unit, and the number of words; the hash of every word.

    Units are cut at ends of sentences and clauses, and stretches of more than
    ``longest`` words before each word of least hash (the last of equal ones) among any
    ``longest // 2 + 1`` consecutive ones. So a cut depends on the words around it and
    not on where a stretch begins. Stretches without a word belong to the unit before.
    """
    codes = np.frombuffer(_lowered(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint64)
    kinds = _kinds()[codes]
    starts = _unit_starts(kinds)
    inside = (kinds & 1) == 0  # neither blank nor line break
    opens = np.zeros(len(codes) + 1, dtype=bool)
    opens[starts] = True
    opens[-1] = True
    at = np.nonzero(inside & (opens[:-1] | ~np.concatenate([[False], inside[:-1]])))[0]
    end = np.nonzero(inside & (opens[1:] | ~np.concatenate([inside[1:], [False]])))[0] + 1
    hashes = run_hashes(codes.astype(np.uint64) + np.uint64(1), at, end)
    unit = np.searchsorted(starts, at, "right") - 1
    begins = np.concatenate([[True], unit[1:] != unit[:-1]]) if len(at) else np.empty(0, dtype=bool)
    bounds = starts[unit]
    width = longest // 2 + 1
    sizes = np.bincount(unit, minlength=len(starts))
    if len(at) >= width and (sizes > longest).any():
        window = np.arange(len(at) - width + 1)
        window = window[(sizes[unit[window]] > longest) & (unit[window] == unit[window + width - 1])]
        places = np.unique(_least_in_windows(hashes, window, width))
        places = places[~begins[places]]
        begins[places] = True
        bounds[places] = end[places - 1]
    first = np.nonzero(begins)[0]
    return np.append(bounds[first], len(text)), np.append(first, len(at)), hashes


def spans(first: np.ndarray, hashes: np.ndarray, fewest: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, hash) of the shortest run from each unit on that has ``fewest`` or more units
    and ``least_words`` or more words; the last units have none."""
    n = len(first) - 1
    stop = np.maximum(np.arange(n) + fewest, np.searchsorted(first, first[:-1] + least_words))
    stop = stop[stop <= n]  # it never decreases, so those with a run come first
    return stop - np.arange(len(stop)), run_hashes(hashes, first[: len(stop)], first[stop]).view(np.int64)


def cutter(fewest: int, least_words: int, longest: int):
    """A function for mapInArrow: every text's number of units and its spans beside its other columns."""

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_units, units, found = [], [], []
            for text in batch.column("text").to_pylist():
                _, first, hashes = cut(text or "", longest)
                sizes, runs = spans(first, hashes, fewest, least_words)
                n_units.append(len(first) - 1)
                units.append(sizes)
                found.append(runs)
            others = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in others]
            columns += [pa.array(n_units, type=pa.int32()), lists(units, pa.int32()), lists(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_units", "units", "spans"])

    return rows


def span_remover(longest: int):
    """A function for mapInArrow: texts without the units from each ``start`` on, ``units`` many.

    Only texts that lose something are cut again.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone")
            offsets = gone.offsets.to_numpy()
            start, units = (gone.values.field(c).to_numpy() for c in ("start", "units"))
            texts, removed = batch.column("text").to_pylist(), np.zeros(len(batch), dtype=np.int64)
            for i in np.nonzero(np.diff(offsets))[0].tolist():
                own = slice(offsets[i], offsets[i + 1])
                text, edges = texts[i], cut(texts[i], longest)[0]
                covered = np.zeros(len(edges), dtype=np.int64)
                np.add.at(covered, start[own], 1)
                np.add.at(covered, start[own] + units[own], -1)
                lost = np.cumsum(covered)[:-1] > 0
                kept = [text[a:b] for a, b in zip(edges[:-1][~lost].tolist(), edges[1:][~lost].tolist())]
                texts[i], removed[i] = text[: edges[0]] + "".join(kept), lost.sum()
            others = [c for c in batch.schema.names if c not in ("text", "gone")]
            columns = [batch.column(c) for c in others]
            columns += [pa.array(texts, type=pa.string()), pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_removed"])

    return rows
