"""Embedding near-duplicates: inverted lists, residual product quantisation, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import staged


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first; ties by number."""
    out = [np.zeros((0, n), dtype=np.int64)]
    for at in range(0, len(x), 4096):
        d = (centres**2).sum(axis=1) - 2 * x[at : at + 4096] @ centres.T
        if n == 1:
            out.append(d.argmin(axis=1)[:, None])
            continue
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        part.sort(axis=1)
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        for j in range(x.shape[1]):
            centres[:, j] = np.where(n > 0, np.bincount(near, weights=x[:, j], minlength=len(centres)) / np.maximum(n, 1), centres[:, j])
    return centres


class Index:
    """Coarse lists and residual codes of unit vectors of one dimension, fitted on a bounded sample.

    A list's centre is a first centre plus a second one for what the first leaves, so k
    centres of each give k * k lists and the lists keep pace with the table. What the
    list leaves is coded with one byte a subspace of about ``width`` components.
    """

    def __init__(self, sample: np.ndarray, lists: int, width: int = 4, codes: int = 256):
        k = int(np.ceil(np.sqrt(lists)))
        self.first = _kmeans(sample, k)
        rest = sample - self.first[nearest(sample, self.first, 1)[:, 0]]
        self.second = _kmeans(rest, -(-lists // k))
        home = self.lists_of(sample, 1)[:, 0]
        rest = sample - self.centre(home)
        self.cuts = np.linspace(0, sample.shape[1], -(-sample.shape[1] // width) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], codes) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    @property
    def lists(self) -> int:
        return len(self.first) * len(self.second)

    def centre(self, number: np.ndarray) -> np.ndarray:
        return self.first[number // len(self.second)] + self.second[number % len(self.second)]

    def lists_of(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first, among those of its nearest first centres."""
        m, k = min(n, len(self.first)), len(self.second)
        n = min(n, m * k)
        out = [np.zeros((0, n), dtype=np.int64)]
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            near = nearest(part, self.first, m)
            rest = part[:, None, :] - self.first[near]
            d = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ self.second.T + (self.second**2).sum(axis=1)
            number = (near[:, :, None] * k + np.arange(k)).reshape(len(part), -1)
            order = np.argsort(d.reshape(len(part), -1), axis=1, kind="stable")[:, :n]
            out.append(np.take_along_axis(number, order, axis=1))
        return np.concatenate(out)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes and the length of what the codes miss."""
        rest = x - self.centre(home)
        codes = np.zeros((len(x), len(self.books)), dtype=np.uint8)
        for s, book in enumerate(self.books):
            part = rest[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = nearest(part, book, 1)[:, 0]
            rest[:, self.cuts[s] : self.cuts[s + 1]] -= book[codes[:, s]]
        return codes, np.sqrt((rest**2).sum(axis=1))

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each query and subspace its products with the code words."""
        return [-2 * x[:, a:b] @ book.T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]

    def distances(self, x: np.ndarray, tables: list[np.ndarray], codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Asymmetric distances from exact queries to coded vectors of any lists: table look-ups and a term a list."""
        centre = self.centre(home)
        word = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        out = (x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + ((centre + word) ** 2).sum(axis=1)
        for s, table in enumerate(tables):
            out += table[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is divided out first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a, b`` among ``n`` nodes -> as few links, node to root, that connect the same nodes."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


FOUND = "a long, b long, n long, list long, cut int, visits boolean"


def _frame(a, b, n, visits=(), list_=0, cut=0) -> pd.DataFrame:
    visits = np.zeros(len(a), dtype=bool) if not len(visits) else visits
    return pd.DataFrame({"a": a, "b": b, "n": n, "list": np.int64(list_), "cut": np.int32(cut), "visits": visits})


def _results(key: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[pd.DataFrame]:
    """Counts of links (``b`` is -1) and connecting links (``n`` is 0) of the linked rows ``a, b``."""
    count = np.zeros(len(key), dtype=np.int64)
    np.add.at(count, a, size[b])
    np.add.at(count, b, size[a])
    some = np.flatnonzero(count)
    left, right = forest(a, b, len(key))
    return [_frame(key[some], np.full(len(some), -1), count[some]), _frame(key[left], key[right], np.zeros(len(left), dtype=np.int64))]


def embedding_dedup(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, probes: int = 12,
    list_size: int = 400, sample: int = 20_000, block: int = 512,
) -> DataFrame:
    """``rows`` -> one row per row: id, ``n_links, component_id, kept``.

    Links are pairs with cosine ``least`` or more in double precision, of vectors of one
    dimension. Equal vectors are one class with a size, so copies never meet pair by pair.
    The index is fitted on about ``sample`` vectors by hash and holds every class in the
    nearest of about one list for each ``list_size`` classes. In a list its members stand
    with their vectors; those of other lists among whose ``probes`` nearest lists it is
    visit it as codes. Table distances, less what a code misses, drop only pairs that
    can't link; then the vectors of the rest, and only these, are sent for the exact
    cosine. So a pair is found if either has the other's list among its nearest (recall
    against brute force is tested, and at least 0.9); one that both lists see counts in
    the first. Lists longer than ``block`` are cut, and a cut's visitors come in portions.
    Only counts and connecting links leave a task. Null, zero and non-finite vectors link
    with nothing: 0 links, own component, kept. Rows that repeat an id are vectors of
    their own; rows without id have their component's smallest. Models are bounded by
    ``sample`` and the number of dimensions; no rows give no rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[vector_col].dataType.simpleString()
    kind, number = ("array<float>", np.float32) if kind == "array<float>" else ("array<double>", np.float64)
    usable = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    names = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]  # of a class, 128 bits
    fine = base.where(usable)
    dims = {r["d"]: r["n"] for r in fine.groupBy(F.size("v").alias("d")).agg(F.approx_count_distinct(F.xxhash64("v"), 0.01).alias("n")).collect()}
    part = min(1.0, sample / max(1, sum(dims.values())))
    picked = fine.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < part * (1 << 30)).select("v").distinct().limit(2 * sample).toPandas()
    by_dim: dict[int, list] = {d: [] for d in dims}
    for v in picked["v"]:
        by_dim[len(v)].append(tuple(v))
    model = {d: Index(unit(np.array(sorted(v) or [[1.0] * d])), max(1, -(-dims[d] // list_size))) for d, v in by_dim.items()}
    index = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby(b["v"].map(len)):
                m, raw = index.value[d], np.stack(part["v"].to_list()).astype(number)
                x = unit(raw)
                near = m.lists_of(x, probes)
                codes, miss = m.encode(x, near[:, 0])
                near = near + (d << 32)
                yield pd.DataFrame({
                    "rep": part["rep"].astype("Int64"), "n": part["n"], "h1": part["h1"], "h2": part["h2"], "home": near[:, 0], "probed": list(near),
                    "vec": [v.tobytes() for v in raw], "codes": [c.tobytes() for c in codes], "miss": miss.astype(np.float32) + np.float32(1e-6),
                })

    classes = fine.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).select("v", "rep", "n", *names)
    shape = "rep long, n long, h1 long, h2 long, home long, probed array<long>, vec binary, codes binary, miss float"
    placed = staged(classes.mapInPandas(place, shape).withColumn("key", F.monotonically_increasing_id()), "placed")

    # Members stand in one cut of their list; codes visit all cuts of other lists, and the later cuts of their own.
    own = placed.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("m"))
    asked = placed.select(F.explode("probed").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("k"))
    sizes = own.join(asked, "list").select("list", F.expr(f"int(ceil(m / {block}))").alias("cuts"), F.expr("int(ceil(k / 8192))").alias("portions"))
    sizes = staged(sizes, "list-sizes")
    mine = F.expr("int(pmod(xxhash64(key), cuts))")
    some = [F.col(c) for c in ("key", "n", "home", "codes", "miss")]
    members = placed.select(F.col("home").alias("list"), *some, "probed", "vec").join(sizes, "list").withColumn("cut", mine)
    members = members.withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    visitors = placed.select(F.explode("probed").alias("list"), *some).join(sizes, "list").withColumn("own", F.when(F.col("home") == F.col("list"), mine).otherwise(-1))
    visitors = visitors.where("own + 1 < cuts").withColumn("cut", F.explode(F.expr("sequence(own + 1, cuts - 1)")))
    visitors = visitors.withColumn("portion", F.expr("int(pmod(xxhash64(key, 1), portions))"))
    both = members.unionByName(visitors, allowMissingColumns=True)
    far = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9

    def first_here(home: np.ndarray, here: int, probed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pair (member i, visitor j) counts in this list: the visitor's own list doesn't see it, or comes later."""
        return (home[j] >= here) | ~(probed[i] == home[j][:, None]).any(axis=1)

    def near_codes(m: Index, x: np.ndarray, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.frombuffer(b"".join(pdf["codes"]), dtype=np.uint8).reshape(len(pdf), len(m.books))
        home, miss, tables = pdf["home"].to_numpy() & 0xFFFFFFFF, pdf["miss"].to_numpy(), m.tables(x)
        for at in range(0, len(pdf), 1024):
            cut = slice(at, at + 1024)
            i, j = np.nonzero(m.distances(x, tables, codes[cut], home[cut]) - miss[cut] <= far)
            yield i, j + at

    def linked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), dtype=bool)
        for c in range(0, len(i), 1 << 16):
            cut = slice(c, c + (1 << 16))
            ok[cut] = np.einsum("ij,ij->i", x[i[cut]], y[j[cut]]) >= least
        return ok

    def vectors(pdf: pd.DataFrame) -> np.ndarray:
        return unit(np.frombuffer(b"".join(pdf["vec"]), dtype=number).reshape(len(pdf), -1))

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links among a cut's members, and the members and visitors whose codes are near enough."""
        here, cut, portion = (int(pdf[c].iloc[0]) for c in ("list", "cut", "portion"))
        stands = pdf["vec"].notna()
        inside, outside = pdf[stands].sort_values("key"), pdf[~stands].sort_values("key")
        if not len(inside):
            return _frame(*[np.zeros(0, dtype=np.int64)] * 3)
        x, m, key = vectors(inside), index.value[here >> 32], inside["key"].to_numpy()
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if portion == 0:
            for i, j in near_codes(m, x, inside):
                i, j = i[i < j], j[i < j]
                ok = linked(x, x, i, j)
                left.append(i[ok])
                right.append(j[ok])
        out = _results(key, inside["n"].to_numpy(), np.concatenate(left), np.concatenate(right))
        probed, home = np.stack(inside["probed"].to_list()), outside["home"].to_numpy()
        asks, asked = np.zeros(len(inside), dtype=bool), np.zeros(len(outside), dtype=bool)
        for i, j in near_codes(m, x, outside):
            ok = first_here(home, here, probed, i, j)
            asks[i[ok]] = asked[j[ok]] = True
        wanted = np.concatenate([key[asks], outside["key"].to_numpy()[asked]])
        none = np.full(len(wanted), -1)
        return pd.concat([*out, _frame(wanted, none, none, np.arange(len(wanted)) >= asks.sum(), here, cut)], ignore_index=True)

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact cosines of a cut's wanted members with its wanted visitors."""
        here = int(pdf["list"].iloc[0])
        pdf = pdf.sort_values(["visits", "key"])
        x, k = vectors(pdf), int((~pdf["visits"]).sum())
        probed, home = np.stack(pdf["probed"].to_list()), pdf["home"].to_numpy()
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(k, len(pdf), 1024):
            i, j = np.nonzero(x[:k] @ x[at : at + 1024].T >= least - 1e-9)
            j += at
            ok = first_here(home, here, probed, i, j)
            i, j = i[ok], j[ok]
            ok = linked(x, x, i, j)
            left.append(i[ok])
            right.append(j[ok])
        return pd.concat(_results(pdf["key"].to_numpy(), pdf["n"].to_numpy(), np.concatenate(left), np.concatenate(right)), ignore_index=True)

    found = staged(both.groupBy("list", "cut", "portion").applyInPandas(narrow, FOUND), "narrowed")
    wanted = found.where("n = -1").select(F.col("a").alias("key"), "list", "cut", "visits").distinct()
    looks = wanted.groupBy("list", "cut").agg(F.expr("int(ceil(count_if(visits) / 8192))").alias("portions"))
    wanted = wanted.join(looks, ["list", "cut"])
    wanted = wanted.withColumn("portion", F.explode(F.expr("if(visits, array(int(pmod(xxhash64(key, 2), portions))), sequence(0, portions - 1))")))
    wanted = wanted.join(placed.select("key", "n", "home", "probed", "vec"), "key")
    exact = staged(wanted.groupBy("list", "cut", "portion").applyInPandas(rerank, FOUND), "reranked")
    links = found.where("n >= 0").unionByName(exact)
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    parts = connected_components(links.where("n = 0").select("a", "b"))
    classes = placed.select("key", "rep", "n", "h1", "h2")
    classes = classes.join(counts, F.col("key") == F.col("a"), "left").join(parts, F.col("key") == F.col("node"), "left")
    classes = staged(classes.select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"), "named")
    least_id = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    classes = classes.join(least_id, "component", "left").select("h1", "h2", "links", F.coalesce("least", "rep").alias("component"))
    out = base.select("id", *(F.when(usable, h).alias(n) for h, n in zip(names, ("h1", "h2"), strict=True))).join(classes, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
