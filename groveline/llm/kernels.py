"""Small helpers that run inside tasks, on the rows of one Arrow or pandas batch."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle

# Send the code itself to the workers, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BITS = 64


def shingle_hashes(text: str | None, size: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words; of the whole sequence if it has fewer.

    bytes.lower() changes A-Z only, and bytes.split() splits at the six ASCII blanks only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), last[:n].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The 64-bit SimHash: a bit is set if over half of the hashes have it."""
    ones = np.zeros(_BITS, dtype=np.int64)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints of texts, as signed 64-bit integers."""
    for texts in batches:
        found = np.array([fingerprint(shingle_hashes(t)) for t in texts], dtype=np.uint64)
        yield pd.Series(found.view(np.int64))


# Odd factors: of the words of a shingle, and of a shingle's value in each of four orders.
WORD_FACTORS = (1540483477, 668265263, 374761393, 1172035187, 1118997045)
ORDER_FACTORS = (1, 2177342782468422677, 4354685564936845355, 2685821657736338717)


def shingle_minima(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The least value of a text's shingles in each of four orders.

    Shingles are runs of as many words as there are ``WORD_FACTORS``, or all words if there
    are fewer. A word's value is the first 64 bits of its MD5, a shingle's the sum of its
    words' values times their factors, in an order times that order's factor, all modulo 2^64.
    ``known`` remembers the words met.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(md5(w).digest()[:8], "big")
    values = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - len(WORD_FACTORS) + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(WORD_FACTORS):
        part = values[i : i + n]
        total[: len(part)] += part * np.uint64(factor)
    return np.array([(total * np.uint64(m)).min() for m in ORDER_FACTORS], dtype=np.uint64)


def page_minima(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``shingle_minima`` of texts, as signed integers in the same order."""
    for texts in batches:
        known: dict[bytes, int] = {}
        found = np.array([shingle_minima(t, known) for t in texts], dtype=np.uint64).reshape(-1, 4)
        signed = (found ^ np.uint64(1 << 63)).view(np.int64)
        yield pd.DataFrame(signed, columns=["s0", "s1", "s2", "s3"])


def close_pairs(
    left: np.ndarray, right: np.ndarray, radius: int, tile: int = 1024
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within ``radius`` bits, tile by tile.

    Both sides are sorted by population count. Two fingerprints differ by at least the
    difference of their population counts, so a pair of tiles whose counts are further
    apart than the radius cannot hold a link and is skipped.
    """
    def cut(values: np.ndarray):
        counts = np.bitwise_count(values)
        order = np.argsort(counts, kind="stable")
        for i in range(0, len(order), tile):
            index = order[i : i + tile]
            yield index, values[index], int(counts[index[0]]), int(counts[index[-1]])

    others = list(cut(right))
    for own, a, low, high in cut(left):
        for index, b, other_low, other_high in others:
            if other_low - high > radius or low - other_high > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if len(i):
                yield own[i], index[j]


def spanning_links(
    values: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """For every position with a link, (position, root): as many links as nodes, not as pairs."""
    root = np.arange(len(values))
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
    linked = np.nonzero(root != np.arange(len(values)))[0]
    return values[linked], values[root[linked]]


def tile_links(radius: int):
    """A function for applyInPandas: the links of one pair of chunks of a block."""

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.ascontiguousarray(rows["fp"].to_numpy(dtype=np.int64)).view(np.uint64)
        first, second = key[-2], key[-1]
        if first == second:
            found = close_pairs(values, values, radius)
        else:
            left = np.nonzero(rows["chunk"].to_numpy() == first)[0]
            right = np.nonzero(rows["chunk"].to_numpy() == second)[0]
            found = (
                (left[i], right[j]) for i, j in close_pairs(values[left], values[right], radius)
            )
        u, v = spanning_links(values, found)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return links


def best_fit(
    lengths: list[int], sources: list[int], clusters: list[int], capacity: int
) -> list[tuple[int, int]]:
    """(bin, offset) of every item, taken in the order given; -1 is no source or no cluster.

    Open bins are kept in the order of their residual room, each with a bitmap of the
    sources and one of the clusters in it. From the tightest bin with room enough the
    search moves to its successors until a bin has neither in common with the item.
    """
    order: list[tuple[int, int]] = []
    of_source: list[int] = []
    of_cluster: list[int] = []
    placed = []
    for need, source, cluster in zip(lengths, sources, clusters):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (need, -1))
        while at < len(order):
            chosen = order[at][1]
            if not (of_source[chosen] & source_bit or of_cluster[chosen] & cluster_bit):
                break
            at += 1
        if at < len(order):
            room, chosen = order.pop(at)
        else:
            room, chosen = capacity, len(of_source)
            of_source.append(0)
            of_cluster.append(0)
        of_source[chosen] |= source_bit
        of_cluster[chosen] |= cluster_bit
        placed.append((chosen, capacity - room))
        insort(order, (room - need, chosen))
    return placed


def _local(values: pd.Series) -> list[int]:
    """Small numbers for equal values, -1 for null."""
    return pd.factorize(values)[0].tolist()


def packer(capacity: int):
    """A function for applyInPandas: packs the texts of one group, whole or in pieces."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "h", "d", "r"], ascending=[False, True, True, True])
        rows = rows.reset_index(drop=True)
        owner, piece, length = [], [], []
        for i, n in enumerate(rows["n_words"].tolist()):
            cuts = max(1, -(-n // capacity))
            owner += [i] * cuts
            piece += range(cuts)
            length += [capacity] * (cuts - 1) + [n - capacity * (cuts - 1)]
        owner, piece, length = np.array(owner), np.array(piece), np.array(length)
        first = np.argsort(-length, kind="stable")
        owner, piece, length = owner[first], piece[first], length[first]
        source = np.array(_local(rows["source"]))[owner]
        shared = rows["cluster"].where(rows["cluster"].duplicated(keep=False))
        cluster = np.array(_local(shared))[owner]
        placed = best_fit(length.tolist(), source.tolist(), cluster.tolist(), capacity)
        bins = np.array([b for b, _ in placed], dtype=np.int64)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].array[owner],
                "piece": piece.astype(np.int32),
                "start_word": piece.astype(np.int64) * capacity,
                "n_words": length.astype(np.int64),
                "bin": (np.int64(key[0]) << 32) + bins,
                "offset": np.array([o for _, o in placed], dtype=np.int64),
            }
        )

    return pack


_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; made once per worker."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _ALPHA[0]


def ngram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of the text's 1-, 2- and 3-grams of letters, hashed; None without a letter.

    Runs of other characters are one blank, and a blank stands at both ends.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    counts = np.zeros(dims, dtype=np.int64)
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in range(3):
        key = key[: len(codes) - n] * np.uint64(0x110001) + codes[n:]
        hashed = key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        counts += np.bincount((hashed % np.uint64(dims)).astype(np.int64), minlength=dims)
    return counts


def document_frequencies(dims: int):
    """A function for mapInPandas: in how many texts each dimension occurs; -1 counts texts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = ngram_counts(text, dims)
                if counts is not None:
                    total += counts > 0
                    n += 1
        met = np.nonzero(total)[0]
        yield pd.DataFrame({"dim": np.append(met, -1), "n": np.append(total[met], n)})

    return rows


def tfidf(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors of the texts that have a letter, and which those are."""
    vectors, has = [], np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        counts = ngram_counts(text, len(idf))
        if counts is not None:
            vector = np.log1p(counts).astype(np.float32) * idf
            vectors.append(vector / np.linalg.norm(vector))
            has[i] = True
    return np.array(vectors, dtype=np.float32).reshape(-1, len(idf)), has


def centroids(idf: np.ndarray, clusters: int, rounds: int, slack: float):
    """A function for applyInPandas: spherical k-means over the sampled texts of one language."""

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors, _ = tfidf(rows.sort_values("text")["text"].tolist(), idf)
        found = {"lang": [], "centre": [], "least": []}
        if len(vectors):
            centres = unit(vectors.mean(axis=0, keepdims=True))
            while len(centres) < min(clusters, len(vectors)):
                far = (vectors @ centres.T).max(axis=1).argmin()
                centres = np.vstack([centres, vectors[far]])
            for _ in range(rounds):
                nearest = (vectors @ centres.T).argmax(axis=1)
                used = [c for c in range(len(centres)) if (nearest == c).any()]
                centres = unit(np.array([vectors[nearest == c].mean(axis=0) for c in used]))
            likeness = vectors @ centres.T
            nearest, best = likeness.argmax(axis=1), likeness.max(axis=1)
            for c, centre in enumerate(centres):
                own = best[nearest == c]
                found["lang"].append(key[0])
                found["centre"].append(centre.tolist())
                found["least"].append(float(slack * own.min()) if len(own) else 0.0)
        return pd.DataFrame(found)

    return fit


def nearest_centroid(langs: list[str], centres: np.ndarray, least: np.ndarray, idf: np.ndarray, block: int = 256):
    """A pandas function: (lang, score, rejected) of every text."""

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*langs, "und"], dtype=object)
        for texts in batches:
            best = np.full(len(texts), len(langs), dtype=np.int64)
            score = np.zeros(len(texts))
            rejected = np.ones(len(texts), dtype=bool)
            values = texts.tolist()
            for i in range(0, len(values), block):
                vectors, has = tfidf(values[i : i + block], idf)
                if len(vectors) and len(langs):
                    likeness = vectors @ centres.T
                    at = i + np.nonzero(has)[0]
                    best[at] = likeness.argmax(axis=1)
                    score[at] = np.clip(likeness.max(axis=1), 0.0, 1.0)
                    rejected[at] = score[at] < least[best[at]]
            yield pd.DataFrame({"lang": names[best], "score": score, "rejected": rejected})

    return classify
