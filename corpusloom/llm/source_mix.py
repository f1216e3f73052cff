"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, column, staged


def share_out(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Split ``total`` by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * float(sizes[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return target


class Flow:
    """Min-cost flow where only the arcs out of the source node cost anything.

    Every path's cost is then that of its first arc, and a saturated first arc is never
    given back, so the primal-dual method opens the arcs in order of cost and completes
    a maximum flow at each: levels by breadth-first search, then a blocking flow.
    """

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []  # arc e and its reverse e ^ 1

    def arc(self, a: int, b: int, room: int) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.head[a].append(e)
        self.head[b].append(e + 1)
        return e

    def _levels(self, s: int, t: int) -> list[int] | None:
        """Steps from each node to ``t``, -1 where there is no way; None if ``s`` has none."""
        level, here = [-1] * len(self.head), [t]
        level[t] = 0
        while here and level[s] < 0:
            ahead = []
            for u in here:
                for e in self.head[u]:
                    v = self.to[e]
                    if self.room[e ^ 1] and level[v] < 0:
                        level[v] = level[u] + 1
                        ahead.append(v)
            here = ahead
        return level if level[s] >= 0 else None

    def complete(self, s: int, t: int) -> None:
        """Add flow from ``s`` to ``t`` until no path has room."""
        head, to, room = self.head, self.to, self.room
        while level := self._levels(s, t):
            at, path, u = [0] * len(head), [], s
            while True:
                if u == t:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    k = next(k for k, e in enumerate(path) if not room[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[u] < len(head[u]):
                    e = head[u][at[u]]
                    if room[e] and level[to[e]] == level[u] - 1:
                        path.append(e)
                        u = to[e]
                        break
                    at[u] += 1
                else:
                    if u == s:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1


def route(patterns: dict[tuple, int], quotas: dict, copies: int = 2) -> dict[tuple, dict]:
    """Words that each membership pattern gives to each of its sources.

    Source node -> pattern: one arc a copy, the k-th costs k squared, so repetition is
    spread before it deepens. Pattern -> its sources -> sink with the sources' quotas.
    """
    names, groups = sorted(quotas, key=_last_null), list(patterns)
    flow = Flow(2 + len(groups) + len(names))
    place = {s: 2 + len(groups) + i for i, s in enumerate(names)}
    given = {p: {s: flow.arc(2 + i, place[s], copies * patterns[p]) for s in p} for i, p in enumerate(groups)}
    for s in names:
        flow.arc(place[s], 1, quotas[s])
    for _ in range(copies):  # the arcs of cost k * k, k = 0, 1, ...
        for i, p in enumerate(groups):
            flow.arc(0, 2 + i, patterns[p])
        flow.complete(0, 1)
    return {p: {s: flow.room[e ^ 1] for s, e in by.items()} for p, by in given.items()}


def _last_null(s):
    return (s is None, (s or "").encode("utf-8"))  # UTF-8 order is code point order


def fill_gap(size: np.ndarray, gap: int) -> np.ndarray:
    """Which documents to take to come near ``gap`` words from below: in order as long as they fit, then by exchanges.

    An exchange puts the document outside that closes most of the rest in place of one inside (or of none).
    """
    taken = np.zeros(len(size), dtype=bool)
    for i, n in enumerate(size):
        if n <= gap:
            taken[i] = True
            gap -= int(n)
    while gap > 0 and not taken.all():
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        outside = outside[np.argsort(size[outside], kind="stable")]
        given = np.r_[0, size[inside]]
        best = np.searchsorted(size[outside], given + gap, side="right") - 1
        gain = np.where(best >= 0, size[outside][best] - given, 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        taken[outside[best[k]]] = True
        if k:
            taken[inside[k - 1]] = False
        gap -= int(gain[k])
    return taken


def source_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources=None, weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, copies: int = 2, seed: int = 7, bucket: int = 256, max_patterns: int = 100_000, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` -> one row per row: id, ``size, source_size, target, taken``.

    ``sources`` is a column with a document's source or array of sources (default: its
    ``source``); sources in code point order, null last, take ``weights`` in turn. The
    whole mix has ``share`` times all words; no target exceeds ``copies`` times its
    source's words. ``source_size`` and ``target`` are sums over a row's sources.

    Words are summed by membership pattern (at most ``max_patterns``, checked; the only
    rows the driver sees, with one threshold each), a min-cost flow routes them, and
    within a pattern whole documents are selected in the order of a seeded hash: every
    document ``n // words`` times, and those before a threshold once more. The
    threshold is found from sums over hash buckets, ten bits deeper at a time until the
    bucket it falls in has at most ``4 * bucket`` rows; only those are looked at row by
    row (``fill_gap``). Rows of equal id and text share the upper 40 bits and are told
    apart by the lower ones, so no number of repeats makes a large bucket. Null texts
    have size 0.
    Unreachable quotas stay unmet. Reruns agree, whatever the partitioning. ``keep``
    names columns of ``docs`` to return as the struct ``kept`` in place of the id (they
    ride along, so that a draw needs no join on ids that may be null or repeated).
    """
    sources = F.col("source") if sources is None else sources
    kind = docs.select(sources.alias("s")).schema["s"].dataType.typeName()
    member = F.coalesce(F.array_sort(F.array_distinct(sources)), F.array(F.lit(None).cast("string"))) if kind == "array" else F.array(sources.cast("string"))
    sized = docs.select(
        F.col(id_col).alias("id"), member.alias("pattern"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("content"),
        F.monotonically_increasing_id().alias("row"), *([F.struct(*map(column, keep)).alias("kept")] if keep else []),
    )
    h = F.shiftleft(F.col("content").bitwiseAND(F.lit((1 << 40) - 1)), 22).bitwiseOR(F.xxhash64("row").bitwiseAND(F.lit((1 << 22) - 1)))
    rows = staged(sized.withColumn("h", h).drop("content"), "sizes")
    spark = docs.sparkSession
    sums = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in sums}
    own: dict = {}
    for p, n in patterns.items():
        for s in p:
            own[s] = own.get(s, 0) + n
    names = sorted(own, key=_last_null)
    target = dict(zip(names, share_out([own[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share * sum(patterns.values()), copies), strict=True))
    given = route(patterns, {s: round(target[s]) for s in names}, copies)
    plan = []
    for r in sums:
        p, n = tuple(r["pattern"]), r["size"]
        words = sum(given[p].values())
        whole, rest = divmod(words, n) if n else (0, 0)
        plan.append((list(p), whole, rest, r["n"], sum(own[s] for s in p), sum(target[s] for s in p)))
    plan_df = spark.createDataFrame(plan, "p2 array<string>, whole long, rest long, n long, source_size long, target double")
    rows = rows.join(F.broadcast(plan_df.drop("rest", "n")), F.expr("pattern <=> p2")).drop("p2")  # at most max_patterns rows

    # The threshold of a pattern: the bucket `edge` of the upper `bits` of the hash, and the words to take from it.
    shape = "p2 array<string>, bits int, edge long, gap long, n long"
    state = spark.createDataFrame([(p[0], 0, 0, p[2], p[3]) for p in plan if p[2]], shape)
    for _ in range(6):  # 60 of 62 bits
        wide = state.where(F.col("n") > 4 * bucket)
        if wide.isEmpty():
            break
        here = rows.join(F.broadcast(wide), F.expr("pattern <=> p2 and shiftright(h, 62 - bits) = edge"))  # at most max_patterns rows
        here = here.select("pattern", "size", "bits", "gap", F.expr("shiftright(h, 52 - bits)").alias("edge"))
        in_order = Window.partitionBy("pattern").orderBy("edge")  # at most 1024 sums
        sums = (
            here.groupBy("pattern", "bits", "gap", "edge").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.sum("words").over(in_order) - F.col("words"))
        )
        found = sums.where("before <= gap and before + words > gap")
        found = found.select(F.col("pattern").alias("p2"), (F.col("bits") + 10).alias("bits"), "edge", (F.col("gap") - F.col("before")).alias("gap"), "n")
        state = staged(state.where(F.col("n") <= 4 * bucket).unionByName(found), "thresholds")
    rows = rows.join(F.broadcast(state.select("p2", "bits", "edge", "gap")), F.expr("pattern <=> p2"), "left").drop("p2")
    rows = rows.withColumn("place", F.expr("shiftright(h, 62 - bits)"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "size", "row"], kind="stable")
        extra = fill_gap(pdf["size"].to_numpy(), int(pdf["gap"].iloc[0]))
        return pdf.assign(extra=extra.astype("int32"))[["row", "extra"]]

    asked = rows.where("place = edge")
    filled = asked.select("pattern", "row", "h", "id", "size", "gap").groupBy("pattern").applyInPandas(fill, "row long, extra int")
    extra = F.when(F.col("place") < F.col("edge"), 1).otherwise(0)
    others = rows.where("edge is null or place <> edge").withColumn("extra", extra)
    named = F.col("kept") if keep else F.col("id").alias(id_col)
    return others.unionByName(asked.join(filled, "row").select(*others.columns)).select(
        named, "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken")
    )
