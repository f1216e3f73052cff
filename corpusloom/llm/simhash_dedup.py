"""SimHash near-duplicates: an inverted index on byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import staged

MAX_DISTANCE = 3
#: Fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes.
MIN_SHARED = 8 - MAX_DISTANCE
#: Of any 5 of 8 positions, 3 lie in the lower or in the upper half; so they contain one of these.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
BITS = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles as an unsigned 64-bit number; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        words, shingle = [b" ".join(words)], 1
    n, digest, block = len(words) - shingle + 1, xxhash.xxh64_intdigest, 1 << 14
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, block):  # a block of shingles at a time, however long the text
        part = words[at : min(at + block, n) + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.array([digest(p, 42) for p in shingles], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the signed form of the 64-bit fingerprint of each row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the eight (position, byte) postings of ``a`` those of ``b`` share, pair by pair."""
    left, right = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) for x in (a, b))
    shared = np.zeros(np.broadcast_shapes(a.shape, b.shape), dtype=np.uint8)
    for p in range(8):
        shared += left[..., p] == right[..., p]
    return shared


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS[np.ascontiguousarray(a ^ b).view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.uint8)


def near_pairs(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """Which of the candidate pairs ``fp[i], fp[j]`` link, and how many pairs each step held.

    Count filtering: a pair that shares fewer than ``MIN_SHARED`` positional bytes has more
    than ``MAX_DISTANCE`` differing bits; only pairs that reach the minimum are verified.
    """
    survivors = np.flatnonzero(tally(fp[i], fp[j]) >= MIN_SHARED)
    linked = survivors[bits_apart(fp[i[survivors]], fp[j[survivors]]) <= MAX_DISTANCE]
    return linked, {"candidates": len(i), "survivors": len(survivors), "links": len(linked)}


def _bytes(fp: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for p in places:
        out = (out << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
    return out


def posting_keys(fp: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """The index keys of fingerprints; any two that link share a key on every level.

    Level 0: three positional bytes (8 keys). Level 1: two more of the other five, of
    which a linked pair shares two at least (x 10). Level 2: one of four 6-bit blocks
    of the last 24 bits, as three bits can't touch all four (x 4). Level 3: one of four
    blocks of the last 18 bits (x 4), after which a key has at most 2**14 fingerprints.
    """
    u = np.uint64
    for t, triple in enumerate(TRIPLES):
        key0 = (u(t) << u(24)) | _bytes(fp, triple)
        if level == 0:
            yield key0
            continue
        others = [p for p in range(8) if p not in triple]
        for c, pair in enumerate(combinations(others, 2)):
            key1 = ((key0 * u(10) + u(c)) << u(16)) | _bytes(fp, pair)
            if level == 1:
                yield key1
                continue
            rest = _bytes(fp, tuple(p for p in others if p not in pair))
            for i in range(4):
                low = u(6 * i)
                key2 = ((key1 * u(4) + u(i)) << u(6)) | ((rest >> low) & u(63))
                if level == 2:
                    yield key2
                    continue
                last = (rest & ((u(1) << low) - u(1))) | ((rest >> (low + u(6))) << low)
                for j, (at, width) in enumerate(((0, 5), (5, 5), (10, 4), (14, 4))):
                    yield ((key2 * u(4) + u(j)) << u(5)) | ((last >> u(at)) & u((1 << width) - 1))


#: The key above: bits that a level adds, and its number of choices.
ABOVE = {1: (16, 10), 2: (6, 4), 3: (5, 4)}


def _postings(reps: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                fp = part["fp"].to_numpy().view(np.uint64)
                for key in posting_keys(fp, level):
                    yield pd.DataFrame({"key": key.view(np.int64), "fp": part["fp"], "rep": part["rep"]})

    return reps.mapInPandas(run, "key long, fp long, rep long")


def _run_links(fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of one key; of a dense group, enough to keep it connected."""
    root = np.arange(len(fp))
    for i in range(len(fp) - 1):
        others = np.arange(i + 1, len(fp))
        near = others[near_pairs(fp, np.full(len(others), i), others)[0]]
        other = np.unique(root[near])
        other = other[other != root[i]]
        if len(other):  # one link for each group that joins: a spanning forest
            first = near[[np.argmax(root[near] == o) for o in other]]
            yield np.full(len(first), rep[i]), rep[first]
            root[np.isin(root, other)] = root[i]


def link_sorted(batches: Iterator[pd.DataFrame], small: int = 16) -> Iterator[pd.DataFrame]:
    """Links from postings sorted by key; a key's rows are held until it is complete."""
    held: pd.DataFrame | None = None

    def links(b: pd.DataFrame) -> pd.DataFrame:
        key, fp, rep = b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["rep"].to_numpy()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=int)
        size = np.diff(np.r_[start, len(key)])
        left, right = [], []
        length = np.repeat(size, size)
        for d in range(1, small):  # short runs: all offsets at once
            i = np.flatnonzero((key[d:] == key[:-d]) & (length[:-d] <= small)) if len(key) > d else []
            if not len(i):
                break
            i = i[near_pairs(fp, i, i + d)[0]]
            left.append(rep[i])
            right.append(rep[i + d])
        for at, n in zip(start[size > small], size[size > small], strict=True):
            for a, c in _run_links(fp[at : at + n], rep[at : at + n]):
                left.append(a)
                right.append(c)
        a = np.concatenate(left) if left else np.array([], dtype=np.int64)
        return pd.DataFrame({"a": a, "b": np.concatenate(right) if right else a})

    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        whole = b["key"].to_numpy() != b["key"].iloc[-1]
        held = b[~whole]
        yield links(b[whole])
    if held is not None:
        yield links(held)


def near_links(reps: DataFrame, bucket: int = 4096) -> DataFrame:
    """``reps(fp, rep)``, fingerprints distinct -> ``links(a, b)`` of ``rep`` ids.

    Plain postings of (position, byte) have 256 values a position, so their lists hold
    a 256th of all rows each and tallying them would cost the square of the corpus.
    The index therefore keys on sets of positions that a pair with enough shared bytes
    can't avoid (``TRIPLES``); the pairs that meet there are tallied over the postings of
    all eight positions, and only those with ``MIN_SHARED`` or more are verified by their
    differing bits (``near_pairs``).
    Keys with more than ``bucket`` fingerprints are split losslessly by
    ``posting_keys`` of the next level; distinct fingerprints bound the last one.
    """
    found, rest, hot = [], reps, None
    for level in range(4):
        postings = _postings(rest, level)
        if level:  # only what lies below a key that was too large
            bits, choices = ABOVE[level]
            up = F.expr(f"shiftrightunsigned(key, {bits}) div {choices}")
            postings = postings.join(hot, up == F.col("hot"), "left_semi")
        if level < 3:
            postings = staged(postings, f"postings{level}")
            sizes = postings.groupBy("key").count().where(F.col("count") > bucket)
            hot = staged(sizes.select(F.col("key").alias("hot")), "hot")
        last = level == 3 or hot.isEmpty()
        cold = postings if last else postings.join(hot, F.col("key") == F.col("hot"), "left_anti")
        found.append(
            cold.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(link_sorted, "a long, b long")
        )
        if last:
            return reduce(DataFrame.unionByName, found)
        rest = postings.join(hot, F.col("key") == F.col("hot"), "left_semi").select("fp", "rep").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = 4096) -> DataFrame:
    """``docs`` -> one row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at three or fewer differing bits; the component is the smallest
    id reachable. Equal fingerprints are one node of the search whatever their number.
    Null and empty texts have fingerprint zero and link as any other. Rows without id
    get their component's smallest id (null if it has none). Other columns are not read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = staged(rows.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    parts = connected_components(near_links(reps.where("rep is not null"), bucket))
    named = reps.join(parts, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
