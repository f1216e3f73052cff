"""Secrets: base patterns, and a linear-chain conditional random field over tokens, decoded by Viterbi."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The contract's patterns; a hex run of 24 is the leftmost greedy run, as nothing but its length is asked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[0-9A-Za-z]{24,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ["assign", "access", "hex", "learned"]

BEGIN, INSIDE, OUTSIDE = range(3)
#: A run of letters and digits or one other sign, with a blank before it if there is one.
TOKEN = re.compile(r"\s?(?:[^\W_]+|[^\w\s]|_)")
#: Tokens before and after one that its label depends on, by their features.
OFFSETS = range(-5, 3)
#: Characters taken at once, and different tokens that a task remembers.
BLOCK, TYPES = 1 << 19, 200_000
#: Parts of a training example around a base match.
BEFORE, AFTER = 16, 14


def base_matches(text: str, longest: int | None = None) -> list[tuple[int, int, int, int]]:
    """``(kind, start, end, value start)`` of the valid matches by start, then kind; ``longest`` is the longest token, if known."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in LONG.finditer(text) if longest is None or longest >= 24 else ():
        found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted((f for f in found), key=lambda f: (f[1], f[0]))


DIGITS, LOWER, UPPER, HEXADECIMAL = map(frozenset, ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"))


def shape(token: str) -> tuple:
    """What a token looks like: the blank before it, and its sign, or its letters, digits and length."""
    word = token.lstrip()
    space = "glued" if len(word) == len(token) else "line" if token[0] in "\n\r" else "spaced"
    if len(word) == 1 and not word.isalnum():
        return space, word
    signs, n = set(word), len(word)
    kinds = "".join(k for k, some in (("9", DIGITS), ("a", LOWER), ("A", UPPER)) if not signs.isdisjoint(some)) + ("" if word.isascii() else "x")
    size = n if n < 4 else 4 + (n >= 6) + (n >= 8) + (n >= 12) + (n >= 16) + (n >= 20) + (n >= 24) + (n >= 32) + (n >= 40)
    turns = 0
    if kinds[0:1] == "9" and len(kinds) > 1:
        changes = sum((a in DIGITS) != (b in DIGITS) for a, b in zip(word, word[1:], strict=False))
        turns = (changes >= 1) + (changes >= 2) + (changes >= 4) + (changes >= 8)
    title = word[:1].isupper() and word[1:].islower()
    return space, kinds + ("T" if title else ""), size, turns, signs <= HEXADECIMAL


def shape_features(of: tuple) -> list[str]:
    space, kinds, *rest = of
    if not rest:
        return [f"sign={kinds}", f"space={space}", f"sign={kinds},{space}"]
    size, turns, hexadecimal = rest
    return [
        f"space={space}", f"kinds={kinds}", f"size={size}", f"turns={turns}", f"hex={hexadecimal}", f"kinds={kinds},{size}",
        f"hex={hexadecimal},{size}", f"turns={turns},{size}",
    ]


def features(token: str) -> list[str]:
    """Shape and form of a token; ``word=`` is kept only for words that the examples have."""
    return [*shape_features(shape(token)), f"word={token.strip().lower()}"]


def file_feature(n: int, signs: int, equals: int) -> int:
    """A document's form: its length, its share of signs, and whether it assigns values."""
    return (n >= 50) + (n >= 500) + 3 * ((signs * 10 >= n) + (signs * 4 >= n)) + 9 * ((equals > 0) + (equals * 50 >= n))


FILES = 27


@dataclass
class Crf:
    """Weights: ``theta[offset, feature, label]``, ``step[label, next label]`` and ``file[form, label]``."""

    names: dict[str, int]
    theta: np.ndarray
    step: np.ndarray
    file: np.ndarray

    def weight(self, names: list[str]) -> np.ndarray:
        """What some features add to begin and inside against outside, at each offset."""
        w = self.theta[:, [self.names[f] for f in names if f in self.names], :].sum(axis=1)
        return w[:, :2] - w[:, 2:]


def chain(e: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums of padded chains ``e[chain, place, label]`` that stand between outside labels.

    Returns each label's probability, each step's summed over all places, and log Z.
    """
    n, length, _ = e.shape
    last, every = mask.sum(axis=1) - 1, np.arange(n)
    top = e.max(axis=2)
    psi, m = np.exp(e - top[:, :, None]), np.exp(step)
    fwd, back, scale = np.zeros_like(e), np.zeros_like(e), np.ones((n, length))
    for t in range(length):
        now = (fwd[:, t - 1] @ m if t else m[OUTSIDE]) * psi[:, t]
        scale[:, t] = np.where(mask[:, t], now.sum(axis=1), 1.0)  # each place's sums are brought to one
        fwd[:, t] = np.where(mask[:, t, None], now / scale[:, t, None], fwd[:, t - 1] if t else 0.0)
    for t in range(length - 1, -1, -1):
        after = (psi[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]) @ m.T if t + 1 < length else m[:, OUTSIDE]
        back[:, t] = np.where((last > t)[:, None], after, m[:, OUTSIDE])
    z = fwd[every, last] @ m[:, OUTSIDE]
    log_z = np.log(z) + (np.log(scale) + top * mask).sum(axis=1)
    p = fwd * back * mask[:, :, None] / z[:, None, None]
    weight = psi * back / (scale * z[:, None])[:, :, None] * mask[:, :, None]
    pairs = np.einsum("nta,ntb->ab", fwd[:, :-1], weight[:, 1:]) * m
    pairs[OUTSIDE] += p[:, 0].sum(axis=0)
    pairs[:, OUTSIDE] += p[every, last].sum(axis=0)
    return p, pairs, log_z


@dataclass
class Examples:
    """Padded chains of token types with labels (-1 beyond the end), and the features of each type."""

    types: np.ndarray  # chain, place + context
    labels: np.ndarray  # chain, place
    form: np.ndarray
    rows: np.ndarray  # one row a feature of a type
    cols: np.ndarray


def loss(model: Crf, x: Examples, decay: float) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood with an L2 penalty, and its gradient by ``theta``, ``step`` and ``file``."""
    n, length = x.labels.shape
    mask, before = x.labels >= 0, -OFFSETS.start
    types, size = int(x.rows.max()) + 1 if len(x.rows) else 1, model.theta.shape[1]
    e = np.broadcast_to(model.file[x.form][:, None, :], (n, length, 3)).copy()
    for k, o in enumerate(OFFSETS):
        table = np.stack([np.bincount(x.rows, model.theta[k, x.cols, y], types) for y in range(3)], axis=1)
        e += table[x.types[:, before + o : before + o + length]]
    p, pairs, log_z = chain(e, model.step, mask)
    gold = np.where(mask, x.labels, OUTSIDE)
    at = np.take_along_axis(e, gold[:, :, None], axis=2)[:, :, 0]
    whole = np.concatenate([np.full((n, 1), OUTSIDE), gold, np.full((n, 1), OUTSIDE)], axis=1)
    steps, last = np.zeros((3, 3)), mask.sum(axis=1)
    for t in range(length + 1):
        some = t <= last  # the step after the last label leads outside; padding has no steps
        np.add.at(steps, (whole[some, t], whole[some, t + 1]), 1)
    score = (at * mask).sum() + (steps * model.step).sum()
    value = (log_z.sum() - score) / n + decay * sum((w**2).sum() for w in (model.theta, model.step, model.file))
    wrong = p.copy()
    wrong[np.arange(n)[:, None], np.arange(length)[None, :], gold] -= mask
    theta = np.zeros_like(model.theta)
    for k, o in enumerate(OFFSETS):
        of = x.types[:, before + o : before + o + length].ravel()
        for y in range(3):
            by_type = np.bincount(of, wrong[:, :, y].ravel(), types)
            theta[k, :, y] = np.bincount(x.cols, by_type[x.rows], size)
    files = np.stack([np.bincount(x.form, wrong[:, :, y].sum(axis=1), FILES) for y in range(3)], axis=1)
    grads = [theta / n, (pairs - steps) / n, files / n]
    return value, [g + 2 * decay * w for g, w in zip(grads, (model.theta, model.step, model.file), strict=True)]


#: Names and plain words for varied examples: the contract's names, and words that stand where names do.
VARIED = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]


def varied(tokens: list[str], labels: list[int], rng: np.random.Generator, words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """An example, and others made of it within the patterns' own language.

    With another name and value; with a long value whose name is any word; with a common
    word, or a number, as the value (no secret); with nothing but words around.
    """
    yield tokens, labels
    if BEGIN not in labels:
        return
    at = labels.index(BEGIN)
    end = at + 1
    while end < len(labels) and labels[end] == INSIDE:
        end += 1
    lead = tokens[at][: len(tokens[at]) - len(tokens[at].lstrip())]
    name = next((i for i in range(at - 1, max(at - 6, -1), -1) if tokens[i].strip().lower() in ("password", "passwd", "secret", "token", "key", "apikey")), None)

    def value(low: int, high: int) -> list[str]:
        letters = ALPHABETS[rng.integers(3)]
        text = "".join(rng.choice(list(letters), rng.integers(low, high)))
        text = text if rng.random() < 0.7 else text[: len(text) // 2] + rng.choice(list("-_./+")) + text[len(text) // 2 :]
        return TOKEN.findall(text)

    def with_(new: list[str], secret: bool, called: str | None) -> tuple[list[str], list[int]]:
        new = [lead + new[0], *new[1:]]
        t, y = tokens[:at] + new + tokens[end:], labels[:at] + ([BEGIN] + [INSIDE] * (len(new) - 1) if secret else [OUTSIDE] * len(new)) + labels[end:]
        if called is not None and name is not None:
            blank = t[name][: len(t[name]) - len(t[name].lstrip())]
            given = TOKEN.findall(called)
            t, y = t[:name] + [blank + given[0], *given[1:]] + t[name + 1 :], y[:name] + [OUTSIDE] * len(given) + y[name + 1 :]
        return t, y

    any_word = lambda: str(rng.choice(words)) if words else "word"
    yield with_(value(8, 41), True, str(rng.choice(VARIED)))
    yield with_(value(24, 49), True, str(rng.choice(VARIED)))
    if name is not None:
        yield with_(value(24, 49), True, any_word())
        yield with_([any_word()], False, any_word())
        yield with_([str(rng.integers(1, 10 ** int(rng.integers(1, 12))))], False, any_word())


def examples(rows: list[tuple[list[str], list[int], int]], rng: np.random.Generator) -> tuple[Crf, Examples]:
    """``rows`` of (tokens, labels, document form) -> an empty model and chains."""
    words = sorted({t.strip() for r in rows for t in r[0] if t.strip().isalpha() and 1 < len(t.strip()) < 12})
    made = [(t, y, form) for tokens, labels, form in rows for t, y in varied(tokens, labels, rng, words)]
    seen = Counter(t for tokens, _, _ in made for t in set(tokens))
    common = Counter()
    for t, n in seen.items():
        common.update({f: n for f in features(t)})
    names = {f: i for i, f in enumerate(sorted(f for f, n in common.items() if n >= 5 or not f.startswith("word=")))}
    types = {t: i for i, t in enumerate(["", *sorted(seen)])}
    pairs = [(i, names[f]) for t, i in types.items() if t for f in features(t) if f in names]
    before, after, length = -OFFSETS.start, OFFSETS.stop - 1, max(len(t) for t, _, _ in made)
    x = np.zeros((len(made), before + length + after), dtype=np.int64)
    y = np.full((len(made), length), -1)
    for i, (tokens, labels, _) in enumerate(made):
        x[i, before : before + len(tokens)] = [types[t] for t in tokens]
        y[i, : len(labels)] = labels
    rows_, cols = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
    model = Crf(names, np.zeros((len(OFFSETS), len(names), 3)), np.zeros((3, 3)), np.zeros((FILES, 3)))
    return model, Examples(x, y, np.array([f for _, _, f in made]), rows_, cols)


def train(rows: list[tuple[list[str], list[int], int]], rounds: int = 80, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Crf | None:
    """Maximum likelihood by Adam; None without a labelled secret."""
    if not any(BEGIN in labels for _, labels, _ in rows):
        return None
    model, x = examples(rows, np.random.default_rng(seed))
    weights = [model.theta, model.step, model.file]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1):
        for w, g, a, b in zip(weights, loss(model, x, decay)[1], m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return model


def viterbi(e: np.ndarray, step: np.ndarray) -> list[int]:
    """Best labels of a chain between outside labels; ties to the label outside, then to the later one."""
    best, back = e[0] + step[OUTSIDE], []
    for row in e[1:]:
        total = best[:, None] + step
        take = 2 - total[::-1].argmax(axis=0)
        back.append(take)
        best = total[take, range(3)] + row
    total = best + step[:, OUTSIDE]
    at = 2 - int(total[::-1].argmax())
    out = [at]
    for take in reversed(back):
        at = int(take[at])
        out.append(at)
    return out[::-1]


class Types(dict):
    """Numbers of different tokens, and what each adds to its own and its neighbours' labels."""

    def __init__(self, model: Crf):
        super().__init__({"": 0})
        self.model, self.shapes, self.words = model, {}, {}
        self.added, self.sign = np.zeros((1 << 12, len(OFFSETS), 2)), np.zeros(1 << 12, dtype=np.int8)

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        if i == len(self.added):
            self.added, self.sign = np.concatenate([self.added, np.zeros_like(self.added)]), np.concatenate([self.sign, np.zeros_like(self.sign)])
        of, word = shape(token), "word=" + token.strip().lower()
        if of not in self.shapes:
            self.shapes[of] = self.model.weight(shape_features(of))
        self.added[i] = self.shapes[of]
        if word in self.model.names:
            if word not in self.words:
                self.words[word] = self.model.weight([word])
            self.added[i] += self.words[word]
        self.sign[i] = 0 if len(of) > 2 else 2 if of[1] == "=" else 1
        return i


@dataclass
class Tagger:
    """Labels of many texts: what each different token adds is looked up, and only stretches that can hold a secret are decoded."""

    model: Crf
    types: Types | None = None

    def gains(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each text what begin and inside score above outside at each token; and the tokens."""
        if self.types is None or len(self.types) > TYPES:
            self.types = Types(self.model)
        before, after = -OFFSETS.start, OFFSETS.stop - 1
        tokens = [TOKEN.findall(t) for t in texts]
        flat, starts, at = [], [], 0
        ids = np.zeros(sum(map(len, tokens)) + (before + after) * (len(tokens) + 1), dtype=np.int64)
        for some in tokens:
            at += before
            ids[at : at + len(some)] = np.fromiter(map(self.types.__getitem__, some), np.int64, len(some))
            starts.append(at)
            at += len(some) + after
        e, rows = np.zeros((len(ids) - before - after, 2)), self.types.added[ids]
        for k, o in enumerate(OFFSETS):
            e += rows[before + o : before + o + len(e), k]
        for some, start in zip(tokens, starts, strict=True):
            own = self.types.sign[ids[start : start + len(some)]]
            form = self.model.file[file_feature(len(some), int((own > 0).sum()), int((own == 2).sum()))]
            flat.append(e[start - before : start - before + len(some)] + (form[:2] - form[2]))
        return flat, tokens

    def secrets(self, gain: np.ndarray) -> list[tuple[int, int]]:
        """Token ranges of the best labelling.

        A stretch of labels other than outside is only in it if it scores above the same
        stretch outside. What it can score is at most the sum of each token's better label
        with the best step to it, and the best step out; so with running sums, the tokens
        from which some such stretch could pass are known, and the others are surely
        outside. Chains between those are decoded as if outside stood on both sides.
        """
        if not len(gain):
            return []
        step = self.model.step - self.model.step[OUTSIDE, OUTSIDE]
        g = (gain + step[:, :2].max(axis=0)).max(axis=1)
        out = float(step[:2, OUTSIDE].max())
        if g.max() <= -max(out, 0.0):
            return []
        sums = np.concatenate([[0.0], np.cumsum(g)])
        low = np.minimum.accumulate(sums[:-1])
        high = np.maximum.accumulate(sums[:0:-1])[::-1]
        can = np.concatenate([[False], high - low > -out - 1e-6, [False]])
        edges = np.flatnonzero(can[1:] != can[:-1])
        found = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            labels = viterbi(np.concatenate([gain[a:b], np.zeros((b - a, 1))], axis=1), step)
            found += [(a + i, a + j) for i, j in stretches(labels)]
        return found


def stretches(labels: list[int]) -> list[tuple[int, int]]:
    """Ranges from a begin (or an inside after outside) to the last inside."""
    out, start = [], None
    for i, y in enumerate([*labels, OUTSIDE]):
        if start is not None and y != INSIDE:
            out.append((start, i))
            start = None
        if start is None and y != OUTSIDE:
            start = i
    return out


def bare(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the signs at its ends that no pattern's value has."""
    value = text[start:end]
    lead = len(value) - len(value.lstrip("\"'`()[]{}<>,;:!? "))
    return start + lead, end - (len(value) - len(value.rstrip("\"'`()[]{}<>,;:!? ")))


def token_places(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Start and end of some tokens, without the blank before them."""
    out = {}
    for i, m in enumerate(TOKEN.finditer(text)):
        if i in wanted:
            out[i] = (m.end() - len(m.group().lstrip()), m.end())
    return out


def label(text: str, found: list[tuple[int, int, int, int]]) -> tuple[list[str], list[int]]:
    """Tokens and their labels by the base matches' values."""
    tokens, labels, regions, k, open_ = [], [], sorted((m[3], m[2]) for m in found), 0, -1
    for m in TOKEN.finditer(text):
        start = m.end() - len(m.group().lstrip())
        while k < len(regions) and regions[k][1] <= start:
            k += 1
        inside = k < len(regions) and regions[k][0] <= start and m.end() <= regions[k][1]
        tokens.append(m.group())
        labels.append(OUTSIDE if not inside else INSIDE if open_ == k else BEGIN)
        open_ = k if inside else -1
    return tokens, labels


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> stretches of labelled tokens: around base matches, around long or mixed tokens without one, and one anywhere.

    Of texts without a base match every eighth is used.
    """
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            found, place = base_matches(text), zlib.crc32(text.encode())
            if not found and place % 8:
                continue
            tokens, labels = label(text, found)
            if not tokens:
                continue
            words = [t.strip() for t in tokens]
            signs = [w for w in words if not w.isalnum()]
            form = file_feature(len(tokens), len(signs), signs.count("="))
            starts = [i for i, y in enumerate(labels) if y == BEGIN]
            hard = [i for i, w in enumerate(words) if labels[i] == OUTSIDE and len(w) >= 10 and (len(w) >= 16 or any(c.isdigit() for c in w))]
            places = starts + hard[: 2 + len(hard) % 3] + [place % len(tokens)]
            for i in places:
                a, z = max(0, i - BEFORE), min(len(tokens), i + AFTER)
                out.append((BEGIN in labels[a:z], tokens[a:z], labels[a:z], form))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.bool_()), pa.array([r[1] for r in out], pa.list_(pa.string())), pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.int32())],
            ["secret", "tokens", "labels", "form"],
        )


def fit(docs: DataFrame, text_col: str = "text", sample: int = 20_000, most: int = 800) -> Crf | None:
    """A field trained on about ``sample`` documents chosen by hash, of which ``most`` different stretches with a secret, and as many without, are used.

    The labels are the base matches' values. Each stretch with one also gives ``varied`` ones.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("text"))
    part = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part * (1 << 30))
    cut = some.mapInArrow(windows, "secret boolean, tokens array<string>, labels array<int>, form int").distinct()
    cut = cut.withColumn("h", F.xxhash64("tokens", "labels", "form"))
    best = F.row_number().over(Window.partitionBy("secret").orderBy("h", "tokens"))
    got = cut.withColumn("place", best).where(F.col("place") <= most).orderBy("secret", "place").select("tokens", "labels", "form").collect()  # 2 * most rows
    return train([(list(r.tokens), list(r.labels), r.form) for r in got])


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """``docs`` -> one row per row: id, ``n_assign, n_access, n_hex, n_learned, base, added``.

    ``base`` and ``added`` are ``array<struct<kind, start, end>>`` in code points, end
    exclusive. Base matches are the three patterns' valid ones. A conditional random field
    (``fit`` on these documents, unless ``model`` is given) labels all tokens of all texts;
    what it tags and no base match touches is added as kind ``learned``. Without a single
    labelled secret to learn from nothing is added. Null texts count as empty, whole texts are
    read by one task each, and rows are decided by themselves, so null, repeated and clashing
    ids don't matter; equal rows get equal spans. Nothing is shuffled but the bounded sample.
    No rows give no rows.
    """
    model = model or fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, base, added, at = b.column("text").to_pylist(), [], [], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size < BLOCK:
                    size, end = size + len(texts[end]), end + 1
                block, at = texts[at:end], end
                gains, tokens = tagger.gains(block) if tagger else ([()] * len(block), [None] * len(block))
                for text, gain, some in zip(block, gains, tokens, strict=True):
                    found = base_matches(text, None if some is None else max(map(len, some), default=0))
                    base.append([(KINDS[k], s, e) for k, s, e, _ in found])
                    ranges = tagger.secrets(gain) if tagger else []
                    places = token_places(text, {i for r in ranges for i in (r[0], r[1] - 1)}) if ranges else {}
                    spans = [bare(text, places[a][0], places[z - 1][1]) for a, z in ranges]
                    added.append([(KINDS[3], s, e) for s, e in spans if s < e and not any(m[1] < e and s < m[2] for m in found)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(base, span), pa.array(added, span)], ["id", "base", "added"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {SPANS}, added {SPANS}")
    n = [F.expr(f"cast(size(filter(base, m -> m.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select(F.col("id").alias(id_col), *n, F.size("added").cast("long").alias("n_learned"), "base", "added")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, by start, then kind as listed."""
    order = lambda m: F.array_position(F.array(*map(F.lit, KINDS)), m["kind"])
    placed = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), order(m).alias("order"), m["end"].alias("end"), m["kind"].alias("kind")))
    one = lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(placed), one), ",")
