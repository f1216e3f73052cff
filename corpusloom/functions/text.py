"""Text columns: cleaning, canonical forms, topics, safety, URLs and tokens. All are Column -> Column."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the data contract.
MOJIBAKE = ["锟斤拷", "ï¿½", "Ã", "Â", "�"]
BLOCKED_TERMS = ["实时面试代答", "面试作弊", "替考", "帮我现场回答"]
SAFETY_TERMS = {
    "violence": ["制作炸弹", "制造炸弹", "制作武器", "杀人教程", "爆炸物制作"],
    "sexual": ["色情", "淫秽", "裸体", "成人视频"],
    "political": ["颠覆国家政权", "分裂国家", "恐怖主义宣传", "政治敏感内容", "推翻政府", "台独宣传"],
    "illegal": ["洗钱教程", "贩毒教程", "诈骗教程", "入侵他人账号"],
}
JUDGE_TRUE = ["正确", "对", "是", "true", "correct", "yes"]
JUDGE_FALSE = ["错误", "错", "否", "false", "incorrect", "no"]
QUESTION_CUES = [
    "什么", "如何", "怎么", "为什么", "为何", "区别", "原理", "流程", "作用",
    "场景", "哪些", "是否", "能否", "何时", "怎样", "请说明", "请解释", "谈谈",
]
TOPIC_PREFIXES = [
    "我想(?:要)?(?:学习|学|了解|掌握|知道)",
    "我希望(?:学习|了解|掌握)",
    "请(?:你)?(?:给我)?(?:讲(?:一下)?|介绍(?:一下)?|解释(?:一下)?|说明(?:一下)?)",
    "给我(?:讲(?:一下)?|介绍(?:一下)?|解释(?:一下)?)",
    "(?:如何|怎么)(?:去)?学习",
    "帮我(?:学习|了解|掌握)",
]
QUESTION = (
    r"(?i)^(?:Q(?:uestion)?\s*\d+\s*[.:：、)]?|Q(?:uestion)?\s*[:：]|(?:问题\s*\d*|第[一二三四五六七八九十百\d]+[题问])\s*[:：]?)"
)
ANSWER = r"(?i)^(?:A(?:nswer)?\s*\d*|答案|解析|解答|总结)\s*[:：]"
CJK = "一-鿿"
# Fixed values of the data contract: radicals that NFKC leaves as they are.
RADICALS = {"⻓": "长", "⻅": "见", "⻣": "骨", "⻛": "风", "⻬": "齐", "⻉": "贝", "⻔": "门", "⻆": "角", "⻢": "马"}


def _replace(col: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        col = F.regexp_replace(col, pattern, to)
    return col


def strip(col: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(col: Column) -> Column:
    """White-space runs to one blank, ends stripped."""
    return strip(F.regexp_replace(col, r"\s+", " "))


def clean_text(col: Column) -> Column:
    """``struct<text, warnings>``. Null counts as empty."""
    raw = F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    text = strip(_replace(raw, (control, " "), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")))
    garbled = F.lit(False)
    for m in MOJIBAKE:
        garbled = garbled | F.contains(text, F.lit(m))
    warnings = F.array_compact(F.array(
        F.when(raw.rlike(control), "control_characters_removed"), F.when(garbled, "possible_mojibake")
    ))
    return F.struct(text.alias("text"), warnings.alias("warnings"))


def clean_public_text(col: Column) -> Column:
    """C2."""
    return strip(_replace(F.coalesce(col, F.lit("")), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")))


def rejoin_identifiers(col: Column) -> Column:
    """Identifiers that a reader split at a capital: ``HashM ap`` -> ``HashMap``."""
    return _replace(col, (r"\b([a-z]+[A-Z])\s+([a-z]+)\b", "$1$2"), (r"\b([A-Z])\s+([a-z]{2,})\b", "$1$2"))


#: Texts that are Python strings at a time.
NFKC_AT_ONCE = 64


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode NFKC, which has no builtin (Arrow's differs); a batch stays in Arrow, and a few texts at a time are Python strings."""
    done = [pa.array([], pa.string())]
    for at in range(0, len(texts), NFKC_AT_ONCE):
        some = texts.slice(at, NFKC_AT_ONCE).to_pylist()
        done.append(pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in some], pa.string()))
    return pa.concat_arrays(done)


def clean_ocr_text(col: Column, radicals: dict[str, str] | None = None) -> Column:
    """NFKC (which resolves most radicals and all ligatures), the other radicals, no doubled blanks."""
    radicals = RADICALS if radicals is None else radicals
    text = F.translate(nfkc(F.coalesce(col, F.lit(""))), "".join(radicals), "".join(radicals.values()))
    return strip(_replace(text, (r"(?<=[!-~])[ \t]+(?=[!-~])", " "), (r"[ \t]*\n[ \t]*", "\n")))


def canonical_text(col: Column, kind: Column | None = None, alphabet: str = "ascii_cjk") -> Column:
    """What exact and near duplicates compare; an empty form falls back to the squeezed text.

    ``alphabet="unicode"`` keeps letters and digits of every script.
    """
    keep = {"ascii_cjk": rf"[^0-9a-z{CJK}]+", "unicode": r"[^\p{L}\p{N}]+"}[alphabet]
    text = F.coalesce(col, F.lit(""))
    prose = let(F.regexp_replace(F.lower(text), keep, ""), lambda p: F.when(p == "", squeeze(text)).otherwise(p))
    return prose if kind is None else F.when(kind.isin("code", "formula", "table"), squeeze(text)).otherwise(prose)


def content_hash(col: Column) -> Column:
    """C11."""
    return F.sha2(squeeze(F.coalesce(col, F.lit(""))), 256)


def make_id(*cols: Column) -> Column:
    """C11: SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def normalize_topic(col: Column) -> Column:
    """The subject without conversational prefixes; never empty unless the input is."""
    topic = squeeze(F.coalesce(col, F.lit("")))
    rest = F.regexp_replace(topic, rf"(?i)^[ ：:,，、\-\t]*(?:(?:{'|'.join(TOPIC_PREFIXES)})[\s:：,，、-]*)+", "")
    rest = F.regexp_replace(rest, r"^[ ：:,，、\-\t]+|[ ：:,，、\-\t]+$", "")
    return F.when(rest == "", topic).otherwise(rest)


def is_url(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def prepare_topic(col: Column) -> Column:
    """``struct<topic, is_url, parts>``."""
    topic = normalize_topic(col)
    parts = F.filter(F.transform(F.split(topic, r"[,，、;；\n]+"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    return F.struct(topic.alias("topic"), is_url(topic).alias("is_url"), F.when(is_url(topic), none).otherwise(F.array_distinct(parts)).alias("parts"))


def blocked_term(col: Column, terms: list[str] = BLOCKED_TERMS) -> Column:
    """C14: the first blocked term that the text contains, else null."""
    low = F.lower(col)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in terms])


def safety_match(col: Column, terms: dict[str, list[str]] = SAFETY_TERMS, normal=nfkc) -> Column:
    """``struct<category, term>`` of the first term contained, else null. ``normal`` may be the identity."""
    text = F.regexp_replace(F.lower(normal(F.coalesce(col, F.lit("")))), r"[^\p{L}\p{N}]+", "")
    found = [
        F.when(F.contains(text, F.lit(t)), F.struct(F.lit(c).alias("category"), F.lit(t).alias("term")))
        for c, some in terms.items() for t in some
    ]
    return F.coalesce(*found)


def mask_secrets(col: Column) -> Column:
    """Words that name a secret are masked in free text."""
    return F.regexp_replace(col, r"(?i)(?:api[_-]?key|secret|token|password|authorization)", "[REDACTED]")


def clean_url(col: Column) -> Column:
    """Without white space around and closing punctuation."""
    return F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"[.,;:!?)\]}>'\"，。；：！？）】》]+$", "")


def url_site(col: Column) -> Column:
    """The host, lower case, or empty."""
    return F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def source_id(url: Column) -> Column:
    """C19."""
    return F.concat(F.lit("search_"), F.left(F.sha1(url), F.lit(12)))


def judge_text(col: Column) -> Column:
    """The two judge options by their synonyms; null for anything else."""
    low = F.lower(squeeze(col))
    return F.when(low.isin(JUDGE_TRUE), "正确").when(low.isin(JUDGE_FALSE), "错误")


def is_question_line(col: Column) -> Column:
    """K1."""
    line = strip(F.coalesce(col, F.lit("")))
    cue = line.rlike("|".join(QUESTION_CUES))
    chinese = F.length(F.regexp_replace(line, f"[^{CJK}]", "")) >= 6
    ends = line.rlike("[?？]$")
    return (line != "") & (
        line.rlike(QUESTION) | (line.rlike(r"^\d+[.、)]\s*") & cue) | (ends & (cue | (chinese & ~line.rlike(r"[=<>()\[\]{};]"))))
    )


def _bigrams(runs: Column) -> Column:
    each = F.transform(
        runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    )
    return F.flatten(each)


def _all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def tokens_eval(col: Column) -> Column:
    """The distinct Latin tokens and CJK bigrams."""
    text = F.coalesce(col, F.lit(""))
    return F.array_distinct(F.concat(_all(F.lower(text), r"[a-z0-9][a-z0-9_+#.\-]+"), _bigrams(_all(text, f"[{CJK}]{{2,}}"))))


def tokens_bm25(col: Column) -> Column:
    """Latin identifiers, CJK characters and bigrams, repeats kept; a text without any is its own token."""

    def found(text: Column) -> Column:
        none = F.array().cast("array<string>")
        chinese = F.concat(_all(text, f"[{CJK}]"), _bigrams(_all(text, f"[{CJK}]{{2,}}")))
        return F.concat(_all(text, r"[a-z][a-z0-9_+.#:/\-]*"), F.when(text.rlike(f"[{CJK}]"), chinese).otherwise(none))

    def tokens(text: Column) -> Column:
        return let(found(text), lambda t: F.when(F.size(t) == 0, F.array(text)).otherwise(t))

    text = F.coalesce(col, F.lit(""))
    split = text.rlike(r"[A-Z]\s")  # only then can an identifier have been split at a capital
    return let(F.lower(F.when(split, rejoin_identifiers(text)).otherwise(text)), tokens)


def tokens_topic(col: Column) -> Column:
    """The grading terms: Latin identifiers, CJK runs up to four whole, else their bigrams."""
    text = F.coalesce(col, F.lit(""))
    runs = _all(text, f"[{CJK}]{{2,}}")
    short, long = F.filter(runs, lambda r: F.length(r) <= 4), F.filter(runs, lambda r: F.length(r) > 4)
    return F.array_distinct(F.concat(_all(F.lower(text), r"[a-z][a-z0-9_+#.\-]+"), short, _bigrams(long)))


def tokens_mixed(col: Column) -> Column:
    """R1d: Latin identifiers and whole CJK runs."""
    return F.array_distinct(_all(F.lower(F.coalesce(col, F.lit(""))), rf"[a-z0-9][a-z0-9_+#.\-]*|[{CJK}]+"))


def nearest_rank(name: str, p: float) -> Column:
    """The value of a column at rank ceil(p n); 0 for no values."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})"), F.lit(0.0))
