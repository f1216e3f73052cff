"""Personal data: base patterns, and bootstrapped contextual extraction (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import SPACES, staged

#: Base kinds in their order. The groups are possessive and the look-arounds pin a match to where the leftmost
#: greedy one starts and ends, so that long runs cost linear time; the language is the contract's.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
#: Key-like strings, whose contexts teach as those of base matches do: 32 signs or more with letters and digits.
KEY = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{32,}+"
KINDS = [*BASE, "id"]
OPEN, CLOSE = "\ue000", "\ue001"
SPACE = f"[{SPACES}]"
#: Patterns or instances looked up in one scan of the texts: a broadcast of at most so many 64-bit numbers.
BLOCK = 1_000_000
#: Confidence of a word that looks like an identifier (a digit, an at sign or an underscore in it) and of any other.
LOOKS, PLAIN = 0.5, 0.0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join=lambda a, b: a + b, block: int = 64) -> Column:
    """What ``join`` makes of all values before each (0 before the first), in about linear time: blocks, then their ends."""

    def scan(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def whole(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block))).otherwise(F.array().cast("array<int>"))
        inner = F.transform(starts, lambda at: scan(F.slice(v, at, F.lit(block))))
        return let(inner, lambda i: let(scan(F.transform(i, lambda s: F.element_at(s, -1))), lambda tops: F.flatten(
            F.transform(i, lambda s, k: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: join(tops[k], x)))
        )))

    return let(values, whole)


def pattern_of(two: Column, one: Column, after: Column) -> tuple[Column, Column]:
    """The lexical patterns of a slot: the two words before it, and the words before and after it; null without them.

    The words are in lower case; an empty one is none.
    """
    left = F.when((two != "") & (one != ""), F.xxhash64(F.lit("L"), two, one))
    return left, F.when((one != "") & (after != ""), F.xxhash64(F.lit("LR"), one, after))


def mentions(text: Column, kind: str, pattern: str, valid=None) -> Column:
    """All valid matches as ``array<struct<kind, start, end, instance, left, around, words>>``, in code points.

    Matches are marked with two private characters (such characters in the text are
    first replaced one for one), the text is split at the marks, and lengths add up.
    ``words`` are the starts of the white-space words that the match touches. The words
    around are looked for as far as the third match before and after, so a match that is
    glued to several others has no pattern.
    """
    none = "array<struct<kind: string, start: int, end: int, instance: bigint, left: bigint, around: bigint, words: array<int>>>"
    taken = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    plain = F.when(taken, F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)
    marked = F.regexp_replace(plain, f"({pattern})", f"{OPEN}$1{CLOSE}")

    def spans(pieces: Column) -> Column:
        n = F.size(pieces)
        value = lambda i: F.substring_index(pieces[i], CLOSE, 1)
        squeezed = lambda first, last: F.split(
            F.regexp_replace(F.translate(F.array_join(F.slice(pieces, first + 1, last - first), ""), CLOSE, ""), f"{SPACE}+", " "), " "
        )
        length = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))

        def placed(start: Column) -> Column:
            # the start of the last word in each piece, if white space is in it
            tail = F.transform(pieces, lambda p, i: let(F.regexp_replace(F.substring_index(p, CLOSE, -1), SPACE, " "), lambda r: F.when(
                F.contains(r, F.lit(" ")), start[i] + F.length(p) - F.when(i > 0, 1).otherwise(0) - F.length(F.substring_index(r, " ", -1))
            ).otherwise(0)))
            inside = F.transform(pieces, lambda p, i: F.when(i > 0, let(F.regexp_replace(F.substring_index(p, CLOSE, 1), SPACE, " "), lambda r: F.when(
                F.contains(r, F.lit(" ")), start[i] + F.length(r) - F.length(F.substring_index(r, " ", -1))
            ).otherwise(0))).otherwise(0))
            latest = F.transform(F.arrays_zip(tail.alias("a"), inside.alias("b")), lambda z: F.greatest(z["a"], z["b"]))
            return let(running(latest, F.greatest), lambda word: each(start, word))

        def each(start: Column, word: Column) -> Column:
            ids = F.sequence(F.lit(1), n - 1)
            ids = ids if valid is None else F.filter(ids, lambda i: valid(value(i)))

            def one(i: Column) -> Column:
                before, after = squeezed(F.greatest(i - 3, F.lit(0)), i), squeezed(i, F.least(i + 3, n))
                whole = lambda a, k: F.when((F.size(a) > k) & (a[F.size(a) - 1 - k] != ""), a[F.size(a) - 1 - k])
                parts = F.split(value(i), SPACE)
                offsets = let(parts, lambda q: let(running(F.transform(q, lambda w: F.length(w) + 1)), lambda at: F.filter(
                    F.transform(q, lambda w, k: F.when((w != "") & (k > 0), start[i] + at[k])), F.isnotnull
                )))
                rest = F.split(F.regexp_replace(F.translate(F.concat(F.substring_index(pieces[i], CLOSE, -1), F.array_join(F.slice(pieces, i + 2, F.lit(2)), "")), CLOSE, ""), f"{SPACE}+", " "), " ")
                following = F.when((F.size(rest) > 1) & (F.try_element_at(rest, F.lit(2)) != ""), F.try_element_at(rest, F.lit(2)))
                left, around = pattern_of(*map(F.lower, (whole(before, 2), whole(before, 1), following)))
                return F.struct(
                    F.lit(kind).alias("kind"), start[i].alias("start"), (start[i] + F.length(value(i))).alias("end"), F.xxhash64(value(i)).alias("instance"),
                    left.alias("left"), around.alias("around"), F.concat(F.array(word[i]), offsets).alias("words"),
                )

            return F.transform(ids, one)

        return F.when(n > 1, let(running(length), placed)).otherwise(F.array().cast(none))

    tried = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(tried, let(F.split(marked, OPEN), spans)).otherwise(F.array().cast(none))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        double = n * 2
        return F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(n)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.left(number(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def slots(docs: DataFrame, block: int = 256) -> DataFrame:
    """``docs(id, row, text)`` -> every white-space word with its patterns: ``(id, row, piece, left, around, pieces, base, k, at)``.

    A text is cut before each word, and its lower-cased form at white space, so the words
    around are looked up by their number. Only whole blocks of words are measured; where a
    word starts, ``_start`` counts within its block, for those that are wanted.
    """
    low = F.concat(F.array(F.lit(""), F.lit("")), F.split(F.lower("text"), f"{SPACE}+"), F.array(F.lit("")))  # two empty words more at the beginning
    starts = F.sequence(F.lit(1), F.size("pieces"), F.lit(block))
    length = F.transform(starts, lambda k: F.length(F.array_join(F.slice("pieces", k, F.lit(block)), "")))
    each = docs.select("id", "row", low.alias("low"), F.split("text", f"(?<={SPACE})(?=[^{SPACES}])").alias("pieces"))
    each = each.withColumn("cut", F.struct(running(length).alias("bases")))
    each = each.select("id", "row", "low", "pieces", F.posexplode("cut.bases").alias("b", "base"))
    each = each.withColumn("k", F.col("b") * block + 1)
    each = each.select("id", "row", "low", "pieces", "base", "k", F.posexplode(F.slice("pieces", F.col("k"), F.lit(block))).alias("at", "piece"))
    word = lambda n: F.get("low", F.col("k") + F.col("at") + (n + 1))
    each = each.where(word(0) != "").withColumns({"two": word(-2), "one": word(-1), "after": word(1)})
    left, around = pattern_of(*map(F.col, ("two", "one", "after")))
    return each.select("id", "row", "piece", left.alias("left"), around.alias("around"), "pieces", "base", "k", "at")


def _start() -> Column:
    """Where a slot's word starts in its text."""
    return F.col("base") + F.length(F.array_join(F.slice("pieces", F.col("k"), F.col("at")), ""))


def _core(word: Column) -> Column:
    """A word without the signs around it: from the first letter, digit, at or plus sign to the last letter or digit; empty if it is signs only."""
    return F.regexp_extract(word, r"(?s)^[^\p{L}\p{N}@+]*+(.*[\p{L}\p{N}])", 1)


def cored(found: DataFrame) -> DataFrame:
    """Words without the signs around them: ``start`` and ``end`` of the rest, ``instance`` and ``prior``; bare signs go."""
    found = found.withColumns({"core": _core(F.col("piece")), "place": _start()}).where("core <> ''")
    start = F.col("place") + F.length(F.regexp_extract("piece", r"^[^\p{L}\p{N}@+]*+", 0))
    prior = F.when(F.col("core").rlike("[0-9@_]"), LOOKS).otherwise(PLAIN)
    return found.select(
        "id", "row", "place", start.alias("start"), (start + F.length("core")).alias("end"), F.xxhash64("core").alias("instance"), prior.alias("prior"), "left", "around",
    )


def _blocks(keys: DataFrame) -> list[DataFrame]:
    """``keys`` (one long column, distinct) in parts of about ``BLOCK`` rows, each small enough to broadcast."""
    n = -(-keys.count() // BLOCK)
    part = F.pmod(F.xxhash64(keys.columns[0]), F.lit(max(n, 1)))
    return [keys.where(part == k) for k in range(n)]


def _standing(docs: DataFrame, block: DataFrame) -> DataFrame:
    """The slots of ``block(pattern)``, at most ``BLOCK`` numbers: ``left`` and ``around`` are null where they aren't its own."""
    left, around = (F.broadcast(block.select(F.col("pattern").alias(p))) for p in ("p1", "p2"))
    hit = slots(docs).join(left, F.col("left") == F.col("p1"), "left").join(around, F.col("around") == F.col("p2"), "left")
    return hit.where("p1 is not null or p2 is not null").withColumns({"left": F.col("p1"), "around": F.col("p2")})


def _each() -> Column:
    return F.explode(F.array_compact(F.array("left", "around")))


def promising(docs: DataFrame, mentioned: DataFrame, least: float, support: int) -> DataFrame:
    """``(pattern)`` of those that can be strong; ``mentioned(pattern, instance)`` has the confident instances, distinct.

    ``support`` of them must stand in it. Words without a digit, an at sign or an underscore are in
    no base match and start at no confidence, so a strong pattern has at most ``good / least``
    different ones. One scan marks them in 256 bits a pattern, combined before the shuffle:
    several words may share a bit, so the bits set are surely no more than the words, and only
    patterns that surely have too many go. Common ones, in which seeds stand by chance, do; most
    of them after a sixteenth of the texts, and the others are marked only for those that stay.
    """
    good = staged(mentioned.groupBy("pattern").agg(F.count(F.lit(1)).alias("good")).where(F.col("good") >= support), "pii-good")
    bits = [F.bit_or(F.expr(f"if(h div 64 = {i}, shiftleft(1L, int(h % 64)), 0L)")).alias(f"b{i}") for i in range(4)]
    first = F.pmod("row", F.lit(16)) == 0
    marks, kept = [], good.select("pattern")
    for part in (docs.where(first), docs.where(~first)):
        blocks = _blocks(kept)
        if not blocks:
            break
        for block in blocks:
            each = _standing(part, block).where(~F.col("piece").rlike("[0-9@_]")).select(_core(F.col("piece")).alias("core"), _each().alias("pattern"))
            each = each.where("core <> ''").withColumn("h", F.pmod(F.xxhash64("core"), F.lit(256)))
            marks.append(staged(each.groupBy("pattern").agg(*bits), "pii-marks"))
        words = reduce(DataFrame.unionByName, marks).groupBy("pattern").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)))
        words = words.select("pattern", F.expr("bit_count(b0) + bit_count(b1) + bit_count(b2) + bit_count(b3)").alias("n"))
        kept = good.join(words, "pattern", "left").where(least * F.coalesce("n", F.lit(0)) <= F.col("good"))
        kept = staged(kept.select("pattern"), "pii-patterns")
    return kept


def look_up(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The words that stand in one of ``patterns(pattern)``: ``cored`` with ``pattern``. One scan a block, no shuffle."""
    found = [cored(_standing(docs, block)) for block in _blocks(patterns)]
    return reduce(DataFrame.unionByName, found).withColumn("pattern", _each()).drop("left", "around")


def contexts(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """All patterns in which one of ``instances(instance)`` stands: ``(pattern, instance)``. One scan a block, no shuffle."""
    found = [
        slots(docs).withColumn("instance", F.xxhash64(_core(F.col("piece")))).join(F.broadcast(block), "instance").select("instance", _each().alias("pattern"))
        for block in _blocks(instances)
    ]
    return reduce(DataFrame.unionByName, found)


def bootstrap(edges: DataFrame, least: float = 0.8, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """Score the graph of patterns and instances; ``edges(pattern, instance, prior)``.

    A pattern is as trustworthy as its instances, smoothed: the sum of their confidences
    over their number plus one; one with fewer than ``support`` distinct confident
    instances is worth nothing. An instance has its prior confidence or that of its best
    pattern. Confidences only grow, and this is repeated until the number of confident
    instances stays. Returns ``patterns(pattern, score)``, the strong ones, and
    ``instances(instance, confidence)``. All in Spark.
    """
    edges = staged(edges.groupBy("pattern", "instance").agg(F.max("prior").alias("prior")), "pattern-edges")
    scores = edges.groupBy("instance").agg(F.max("prior").alias("confidence"))
    before = -1
    while True:
        rated = edges.join(scores, "instance").groupBy("pattern").agg(
            F.sum("confidence").alias("hits"), F.sum((F.col("confidence") >= least).cast("int")).alias("good"), F.count(F.lit(1)).alias("n")
        )
        strong = staged(rated.select("pattern", F.when(F.col("good") >= support, F.col("hits") / (F.col("n") + 1)).otherwise(0.0).alias("score")), "patterns")
        strong = strong.where(F.col("score") >= least)
        best = edges.join(strong, "pattern", "left").groupBy("instance")
        scores = staged(best.agg(F.greatest(F.max("prior"), F.coalesce(F.max("score"), F.lit(0.0))).alias("confidence")), "instances")
        now = scores.where(F.col("confidence") >= least).count()
        if now == before:
            return strong, scores
        before = now


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, support: int = 3) -> DataFrame:
    """``docs`` -> one row per row: id, ``n_email, n_ip, n_card, n_phone, n_id, base, added``.

    ``base`` and ``added`` are ``array<struct<kind, start, end>>`` in code points, end
    exclusive. Base matches are the four patterns, validated, failing ones dropped. They
    and key-like strings are the seeds: the two words before, or the words on either side,
    make a lexical pattern. ``promising`` ones are looked up in all texts,
    ``bootstrap`` scores the graph of patterns and words, newly confident words give new
    patterns, and so on until there are none. Whatever word stands in a high-confidence
    pattern, without the signs around it, is added as kind ``id`` unless a base match
    touches it; its looks only weigh in the score. Null texts count as empty; whole texts
    are read, and only matches leave a scan. Rows that repeat an id and text get the same
    spans. No mention of seeds: nothing is added. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), text.alias("text"))
    kinds = {k: mentions(F.col("text"), k, p, lambda v, k=k: _valid(k, v)) for k, p in BASE.items()}
    found = staged(rows.select("id", "row", F.concat(*kinds.values()).alias("base"), mentions(F.col("text"), "key", KEY).alias("keys")), "pii-matches")
    base = found.select("id", "row", F.explode("base").alias("m")).select("id", "row", "m.*")
    taken = base.select("id", "row", F.explode("words").alias("place")).distinct()
    here = lambda a, b: (F.col(f"{a}.row") == F.col(f"{b}.row")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.place") == F.col(f"{b}.place"))
    keys = found.select("id", "row", F.explode("keys").alias("m")).select("id", "row", "m.*").withColumn("place", F.col("words")[0])
    keys = keys.alias("a").join(taken.alias("b"), here("a", "b"), "left_anti")
    each = _each().alias("pattern")
    seeds = staged(base.select(each, "instance").unionByName(keys.select(each, "instance")).distinct(), "pii-seeds")
    key_slots = keys.select("id", "row", "place", "start", "end", "instance", F.lit(1.0).alias("prior"), each)
    known = promising(rows, seeds, least, support)
    added = key_slots.where("false")
    if not known.isEmpty():
        seen = None  # words that stand in a known pattern, no base match in them
        new = known
        while True:
            words = look_up(rows, new)
            words = words.alias("a").join(taken.unionByName(keys.select("id", "row", "place")).alias("b"), here("a", "b"), "left_anti")
            words = staged(words, "pii-words")
            seen = words if seen is None else seen.unionByName(words)
            graph = seeds.join(known, "pattern", "left_semi").withColumn("prior", F.lit(1.0)).unionByName(seen.select("pattern", "instance", "prior"))
            strong, scores = bootstrap(graph, least, support)
            sure = scores.where(F.col("confidence") >= least).select("instance")
            fresh = staged(sure.join(seeds.select("instance").distinct(), "instance", "left_anti"), "pii-new")
            if fresh.isEmpty():
                break
            more = seeds.unionByName(contexts(rows, fresh).select("pattern", "instance")).distinct()
            new = staged(promising(rows, more, least, support).join(known, "pattern", "left_anti"), "pii-patterns")
            if new.isEmpty():
                break
            known = staged(known.unionByName(new), "pii-known")
        added = key_slots.unionByName(seen.select(*key_slots.columns)).join(strong.select("pattern"), "pattern", "left_semi")
    added = (
        added.select("id", "row", F.struct(F.lit("id").alias("kind"), "start", "end").alias("m"))
        .groupBy("id", "row").agg(F.array_sort(F.collect_set("m")).alias("added"))
    )
    added = added.select(F.col("id").alias("id2"), F.col("row").alias("row2"), "added")
    short = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = found.select("id", "row", short.alias("base")).join(added, F.expr("row = row2 and id <=> id2"), "left")
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    out = out.withColumn("added", F.coalesce("added", none))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(F.col("id").alias(id_col), *counts, F.size("added").cast("long").alias("n_id"), "base", "added")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda m: m["kind"] == kind)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, by kind as listed, then start."""
    ordered = F.concat(*(F.array_sort(_of_kind(spans, k)) for k in KINDS))
    one = lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(ordered, one), ",")
