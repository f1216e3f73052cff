"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ranks import ranked
from corpusloom.llm.shared import staged
from corpusloom.llm.tokens import VOCABULARY, Table, packed, whole_tokens


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` -> ``(id, piece, start, length, ids_crc32)``: token ids with ``end_id``, cut where longer than ``size``."""
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))  # at most the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, end = Table(vocabulary, proved.value, packed), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["text"], strict=True):
                ids = b"".join([*table.of(text), end])
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    out.append((key, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by remaining capacity: a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)  # bins below a node
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, left: int, n: int) -> None:
        node = left + self.leaves
        while node:
            self.open[node] += n
            node >>= 1

    def put(self, left: int, bin_id: int) -> None:
        self.bins[left].append(bin_id)
        self._add(left, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a bin of the smallest remaining capacity of ``least`` or more: (capacity, bin)."""
        node = least + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1  # up until a right-hand neighbour has a bin
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down to its smallest capacity
                node = 2 * node + (not self.open[2 * node])
        left = node - self.leaves
        self._add(left, -1)
        return left, self.bins[left].pop()


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first; ties in the order given."""
    bins, offsets, tree, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenBins(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            left, bin_id, used = size, used, used + 1
        else:
            left, bin_id = found
        bins[i], offsets[i] = bin_id, size - left
        if left > n:
            tree.put(left - n, bin_id)
    return bins, offsets


#: A run of pieces of one length: the first one's rank, the first bin and its offset, and how many pieces each bin takes in turn.
RUN = np.dtype([("length", np.int64), ("rank", np.int64), ("bin", np.int64), ("offset", np.int64), ("each", np.int64)])


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best fit decreasing of ``counts[length]`` pieces -> runs by length, then rank.

    Pieces of one length are alike, and so are bins with one remaining capacity, so a step
    places a run of the former in a run of the latter, wherever ``best_fit`` would place
    them one by one: the tightest bin takes pieces until it has no room for another, then
    the next one does. A step uses up a run of bins or the pieces of a length; so there are
    about as many runs as lengths times the runs that are still open to them, however many
    pieces there are.
    """
    tree, runs, out, used = OpenBins(size), [], [], 0  # runs of bins: first, how many

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            runs.append((first, n))
            tree.put(left, len(runs) - 1)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            found = tree.take(length)
            if found is None:
                each = size // length
                left, first, n = size, used, -(-todo // each)
                used += n
            else:
                left, (first, n) = found[0], runs[found[1]]
                each = left // length
            full = min(n, todo // each)
            some = min(todo - full * each, each) if full < n else 0  # the last bin takes what there is
            out.append((length, rank, first, size - left, each))
            put(left - each * length, first, full)
            if some:
                put(left - some * length, first + full, 1)
            put(left, first + full + (some > 0), n - full - (some > 0))
            rank += full * each + some
            todo -= full * each + some
    return np.sort(np.array(out, dtype=RUN), order=["length", "rank"])


def pack(parts: DataFrame, size: int = 4096, group: int = 8192) -> DataFrame:
    """``parts`` with ``row`` (a number of its own for each row) and ``length`` -> ``sequence_id, offset`` besides.

    Best fit decreasing over all rows, whose lengths are 1 to ``size``: only the counts of
    lengths come to the driver, at most ``size`` numbers, where ``plan`` decides for runs of
    equal lengths. Rows are numbered within their length (``ranked``, so a frequent length is
    no task's burden) and look their place up; equal lengths are in order of ``row``. ``group``
    is the number of rows a task places at a time. Repeated and null ids don't matter. No
    rows give no rows.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = parts.sparkSession.sparkContext.broadcast(plan(counts, size))  # about as many as lengths, a few for each
    names = [*parts.columns, "sequence_id", "offset"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = runs.value
        starts = np.searchsorted(of["length"], np.arange(size + 2))
        for b in batches:
            for at in range(0, len(b), group):
                part = b.iloc[at : at + group]
                length, rank = part["length"].to_numpy(), part["rank"].to_numpy()
                i = np.zeros(len(part), dtype=np.int64)
                for n in np.unique(length):
                    own = length == n
                    i[own] = starts[n] + np.searchsorted(of["rank"][starts[n] : starts[n + 1]], rank[own], side="right") - 1
                k, run = rank - of["rank"][i], of[i]
                yield part.assign(sequence_id=run["bin"] + k // run["each"], offset=run["offset"] + k % run["each"] * length)[names]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked(parts, ["length"], ["row"]).drop("n").mapInPandas(deal, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY, group: int = 8192) -> DataFrame:
    """Tokenise ``docs`` and pack them into as few sequences of ``size`` tokens as best fit decreasing finds.

    One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``.
    Null texts are empty and hold ``end_id`` alone. Rows that repeat an id, or have none,
    are packed as documents of their own. A text of any length is tokenised whole by one task.
    Pieces of equal length are dealt in the order in which they were written. Other columns
    aren't read, whatever their names. No rows give no rows. Tokens are made once and staged.
    """
    parts = staged(pieces(docs, id_col, text_col, size, end_id, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(parts, size, group).drop("row").withColumnRenamed("id", id_col)
