"""R3 at scale: an inverted-list index over unit vectors whose lists and members are skipped by their distances' bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import top_k
from corpusloom.sources.stages import staged

#: What rounding of scores and sums of squares may hide.
SLACK = 4e-9
FOUND = "score double, lists int, rows_read long"


def unit(x: pd.Series) -> np.ndarray:
    """Rows of vectors at length one."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in x])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centres."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0))


def centres_of(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """At most ``k`` centres of a sample."""
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        near = np.concatenate([apart(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class VectorIndex:
    """``rows(list, block, far, chunk_id, vec)``: each vector in the list of its nearest centre, ``far`` from it.

    ``centres``, and each list's ``radius`` (of its farthest member) and number of ``blocks``, are
    bounded by the number of lists.
    """

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray


def _usable(column: str) -> str:
    return f"{column} is not null and exists({column}, x -> x <> 0) and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def build_index(vectors: DataFrame, lists: int | None = None, most: int = 4096, sample: int = 20_000, block: int = 4096) -> VectorIndex:
    """``vectors(chunk_id, embedding)`` -> an index with about a list for each square root of the rows, ``most`` at most.

    The centres are fitted on about ``sample`` vectors chosen by hash; all vectors are
    indexed. A list's members stand in blocks of about ``block``, so a hot list is many
    groups. Null, zero and non-finite vectors are left out; all others have one dimension.
    No rows give an empty index.
    """
    rows = vectors.where(_usable("embedding")).select("chunk_id", "embedding")
    n = rows.count()
    part = min(1.0, sample / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < part * (1 << 30)).select("embedding").distinct().limit(2 * sample).toPandas()
    some = sorted(map(tuple, some["embedding"]))
    lists = lists or max(1, min(most, int(np.ceil(np.sqrt(n)))))
    centres = centres_of(unit(pd.Series(some)), lists) if some else np.zeros((1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most `most` vectors

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                rows = b.iloc[at : at + 2048]
                x = unit(rows["embedding"])
                d = apart(x, shared.value)
                near = d.argmin(axis=1)
                yield pd.DataFrame({"list": near.astype(np.int32), "far": d[np.arange(len(x)), near], "chunk_id": rows["chunk_id"], "vec": list(x)})

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    placed = staged(rows.mapInPandas(place, f"list int, far double, chunk_id {kind}, vec array<double>"), "vectors")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toPandas()  # a row a list
    radius, blocks = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    radius[sizes["list"]] = sizes["radius"]
    blocks[sizes["list"]] = -(-sizes["n"] // block)
    cuts = F.lit(1) if blocks.max(initial=0) <= 1 else F.element_at(F.array(*map(F.lit, blocks.tolist())), F.col("list") + 1)
    return VectorIndex(placed.withColumn("block", F.pmod(F.xxhash64("chunk_id"), cuts).cast("int")), centres, radius, blocks)


def _asks(queries: DataFrame, index: VectorIndex, probes: int, rest: bool) -> DataFrame:
    """``queries(query_id, q[, reach])`` -> a row for each list (and block) a query looks into, with its distance to the centre.

    Without ``rest`` these are its ``probes`` nearest lists that have members; with it, the
    others that may hold something within ``reach``: by the triangle inequality no member is
    nearer than the centre's distance less the list's radius.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radius, blocks = shared.value
        full = np.flatnonzero(blocks)
        for b in batches:
            for at in range(0, len(b) if len(full) else 0, 256):
                part = b.iloc[at : at + 256]
                d = apart(np.stack(part["q"].to_list()), centres[full])
                order = np.argsort(d, axis=1, kind="stable")
                look = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(look, order[:, :probes], True, axis=1)
                if rest:
                    look = ~look & (d - radius[full] <= part["reach"].to_numpy()[:, None])
                i, j = np.nonzero(look)
                n = blocks[full[j]]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = np.repeat(i, n), np.repeat(j, n)
                rows = part.iloc[i]
                yield rows.assign(list=full[j].astype(np.int32), block=block.astype(np.int32), dist=d[i, j])[[*part.columns, "list", "block", "dist"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(run, f"{kinds}, list int, block int, dist double")


def _look(asks: DataFrame, index: VectorIndex, k: int, portion: int = 4096) -> DataFrame:
    """Each block's best ``k`` for each query that asks it, and a row without ``chunk_id`` for what was read.

    A member is read only if its own distance to the centre leaves it within ``reach``. The
    queries of a block come in portions, to which its members are copied.
    """
    asks = staged(asks, "asks")
    number = asks.groupBy("list", "block").agg(F.expr(f"int(ceil(count(1) / {portion}))").alias("portions"))
    members = index.rows.join(number, ["list", "block"]).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    mine = asks.join(number, ["list", "block"]).withColumn("portion", F.pmod(F.xxhash64("query_id"), F.col("portions")).cast("int"))
    mine = mine.select(*(F.col(c).alias(c) for c in mine.columns))  # names of its own beside the members'
    query, chunk = asks.schema["query_id"].dataType.simpleString(), index.rows.schema["chunk_id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "chunk_id": [], "score": [], "lists": [], "rows_read": []})]
        if len(left) and len(right):
            left = left.sort_values("far", kind="stable")
            far, x, keys = left["far"].to_numpy(), np.stack(left["vec"].to_list()), left["chunk_id"].to_numpy()
            once = int(left["block"].iloc[0]) == 0
            for r in right.itertuples():
                a, z = np.searchsorted(far, r.dist - r.reach - SLACK), np.searchsorted(far, r.dist + r.reach + SLACK, side="right")
                s = np.round(x[a:z] @ r.q, 12)
                best = np.lexsort((keys[a:z], -np.round(s, 9)))[:k]
                out.append(pd.DataFrame({"query_id": r.query_id, "chunk_id": [*keys[a:z][best], None], "score": [*s[best], np.nan], "lists": [0] * len(best) + [int(once)], "rows_read": [0] * len(best) + [z - a]}))
        return pd.concat([o for o in out if len(o)] or out, ignore_index=True)

    keys = ["list", "block", "portion"]
    return members.groupBy(keys).cogroup(mine.groupBy(keys)).applyInPandas(run, f"query_id {query}, chunk_id {chunk}, {FOUND}")


def search(queries: DataFrame, index: VectorIndex, k: int = 50, probes: int = 16, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, embedding)`` -> the best ``k`` by cosine, ``(query_id, chunk_id, score, rank)``, and the work done.

    First each query looks into its ``probes`` nearest lists. With ``exact`` the ``k``-th
    score found bounds how far a better one can be, and a second pass looks into every other
    list that may hold one, and there only at members that the bound leaves: the
    result is then that of a full scan. Ties (to nine digits) go by ``chunk_id``. The work is
    ``(query_id, lists, rows_read)``. Queries without a usable vector hit nothing.
    """
    asked = staged(queries.where(_usable("embedding")).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")

    def norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"query_id": b["query_id"], "q": list(unit(b["embedding"]))})

    kind = asked.schema["query_id"].dataType.simpleString()
    asked = asked.mapInPandas(norm, f"query_id {kind}, q array<double>")
    found = staged(_look(_asks(asked.withColumn("reach", F.lit(4.0)), index, probes, False), index, k), "knn")
    if exact:
        kth = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * (F.col("score") - SLACK), F.lit(0.0))).alias("kth"))
        reach = asked.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("kth", F.lit(4.0)).alias("reach"))
        found = found.unionByName(staged(_look(_asks(reach, index, probes, True), index, k), "knn-rest"))
    work = found.where("chunk_id is null").groupBy("query_id").agg(F.sum("lists").alias("lists"), F.sum("rows_read").alias("rows_read"))
    return _ranked(found, k), work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_k(found.where("chunk_id is not null").select("query_id", "chunk_id", "score"), k)
