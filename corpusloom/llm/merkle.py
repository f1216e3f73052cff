"""A Merkle manifest of a table: content-addressed records, and proofs by descent from the root."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ranks import ranked
from corpusloom.llm.shared import staged

#: Consecutive nodes under one parent.
FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SEGMENTS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that fields put together stay apart: ``-`` for null, else its bytes' number, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


@dataclass
class Tree:
    """``store[h]`` maps the digests at height h + 1 to their children; ``tops(tree, digest, height)`` has the roots."""

    store: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame) -> Tree:
    """``nodes(tree, rank, n, digest)``, as ``ranked`` numbers them -> the records of all trees, level by level.

    A level has an eighth of the nodes of the one below, so all levels together shuffle
    little more than the leaves' digests. Equal subtrees share a record.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    now, store, tops = nodes, [], [nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))]
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct(F.col("rank") % FAN, "digest")))
        runs = now.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN}").alias("rank"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        runs = runs.agg(F.transform(children, lambda c: c["digest"]).alias("children"))
        now = staged(runs.withColumn("digest", digest(F.array_join("children", ""))), "merkle-level")
        store.append(now.select("digest", "children"))
        tops.append(now.where("n = 1").select("tree", "digest", F.lit(len(store)).alias("height")))
        most = -(-most // FAN)
    return Tree(store, reduce(DataFrame.unionByName, tops))


def descend(tree: Tree, starts: DataFrame, wanted: DataFrame, keep: list[str], last: int) -> tuple[DataFrame, DataFrame]:
    """From the roots ``starts(tree, digest, height, path, *keep)`` down to height ``last``, where requests want it.

    ``wanted(tree, run)`` are the requested nodes at height ``last``. At each step the node
    is looked up by its digest, the child of the request's next rank digit is chosen, and
    the children beside it become a segment of the path. Requests with the same digits so
    far go down as one row, so the nodes near the root are no hot keys. Returns the nodes
    at ``last`` that are no root of less height, ``(tree, run, digest, path, *keep)``, and the
    roots that are lower.
    """
    none = starts.select("tree", F.lit(0).cast("long").alias("run"), "digest", "path", *keep).where("false")
    now = none
    for height in range(len(tree.store), last, -1):
        roots = starts.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), "digest", "path", *keep)
        asked = wanted.select("tree", F.expr(f"run div {FAN ** (height - 1 - last)}").alias("run")).distinct()
        found = now.unionByName(roots).join(tree.store[height - 1].distinct(), "digest")
        found = found.select("tree", "run", "path", "children", *keep, F.posexplode("children").alias("digit", "child"))
        found = found.select(
            "tree", (F.col("run") * FAN + F.col("digit")).alias("run"), F.col("child").alias("digest"),
            F.concat("path", F.array(segment(F.col("children"), F.col("digit")))).alias("path"), *keep,
        )
        now = staged(found.join(asked, ["tree", "run"], "left_semi"), "merkle-path")
    roots = starts.where(F.col("height") == last).select("tree", F.lit(0).cast("long").alias("run"), "digest", "path", *keep)
    return now.unionByName(roots), starts.where(F.col("height") < last)


def segment(children: Column, digit: Column) -> Column:
    """The unselected children, left and right of the selected one."""
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FAN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path from the root, level by level from the leaf."""
    return digest(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""))


def folded(path: Column, leaf_digest: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.reverse(path), leaf_digest, lambda node, s: digest(s["left"], node, s["right"]))


def merkle_manifest(
    docs: DataFrame, fields: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang",
    tampered: Column | None = None, changes: dict[str, Column] | None = None,
) -> DataFrame:
    """``docs`` -> one row per row: id, ``leaf, subroot, root, proof_sha256, folded_root, verified``.

    Each row is a leaf of its group's tree, by id (nulls first), then by digest; the
    groups' roots, by group (null first, then by bytes), are the leaves of the upper tree.
    ``grow`` stores digest-to-children records; all rows are then requested together and
    ``descend`` from the root. Eight leaves under one parent travel as one row and take their
    own siblings only where their proof is made, so no path is shuffled once for each row.
    Where ``tampered`` holds, ``folded_root`` starts from the row with ``changes`` in place of
    its columns, and ``verified`` tells whether it is the root all the same. Null fields are
    part of the leaf's form; texts of any length cross no network. Rows that repeat are
    leaves of their own. Other columns of ``docs`` aren't read. A group of one row has its leaf
    as root, a single group its subroot. No rows give no rows.
    """
    fields, changes = fields or FIELDS, changes or {}
    changed = leaf([changes.get(c, F.col(f"`{c}`")) for c in fields])
    now = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        leaf([F.col(f"`{c}`") for c in fields]).alias("digest"), now.alias("now"),
    )
    leaves = staged(ranked(staged(rows, "merkle-leaves"), ["tree"], ["id", "digest"]), "merkle-ranks")
    lower = grow(leaves.select("tree", "rank", "n", "digest"))
    subroots = ranked(lower.tops.withColumnsRenamed({"tree": "group"}).withColumn("tree", F.lit("")), ["tree"], ["group"])
    subroots = staged(subroots, "merkle-subroots")
    upper = grow(subroots.select("tree", "rank", "n", "digest"))

    start = upper.tops.select("*", F.array().cast(SEGMENTS).alias("path"), F.col("digest").alias("root"))
    places, _ = descend(upper, start, subroots.select("tree", F.col("rank").alias("run")), ["root"], 0)
    starts = subroots.select("tree", F.col("rank").alias("run"), "group", "height").join(places, ["tree", "run"])
    starts = starts.select(F.col("group").alias("tree"), "digest", "height", "path", "root", F.col("digest").alias("subroot"))
    starts = staged(starts, "merkle-starts")

    ask = F.struct(F.col("rank").alias("rank"), "id", F.col("digest").alias("leaf"), "now")
    asks = leaves.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN}").alias("run")).agg(F.collect_list(ask).alias("asks"))
    asks = staged(asks, "merkle-requests")
    keep = ["root", "subroot"]
    parents, alone = descend(lower, starts, asks.select("tree", "run"), keep, 1)
    if lower.store:
        runs = asks.join(parents, ["tree", "run"]).join(lower.store[0].distinct(), "digest")
        each = runs.select(*keep, "path", "children", F.explode("asks").alias("a")).select(
            *keep, "a.id", "a.leaf", "a.now",
            F.concat("path", F.array(segment(F.col("children"), (F.col("a.rank") % FAN).cast("int")))).alias("path"),
        )
    else:
        each = leaves.where("false").select(*[F.lit("").alias(k) for k in keep], "id", F.col("digest").alias("leaf"), "now", F.array().cast(SEGMENTS).alias("path"))
    lone = leaves.where("n = 1").select("tree", "id", F.col("digest").alias("leaf"), "now").join(alone.select("tree", *keep, "path"), "tree")
    each = each.unionByName(lone.select(*each.columns))
    out = each.select("id", "leaf", *keep, proof(F.col("path")).alias("proof"), folded(F.col("path"), F.coalesce("now", "leaf")).alias("folded"))
    return out.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
