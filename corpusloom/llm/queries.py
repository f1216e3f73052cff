"""The registered queries of the numbered operators, over their whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.chat_format import format_records, read_back, records_from_turns
from corpusloom.llm.embedding_dedup import embedding_dedup
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.language_id import fit, held_out, identify
from corpusloom.llm.merkle import merkle_manifest
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.phrases import collocations
from corpusloom.llm.pii import find_pii, span_text
from corpusloom.llm.secrets import find_secrets
from corpusloom.llm.secrets import span_text as secret_text
from corpusloom.llm.shared import table
from corpusloom.llm.simhash_dedup import simhash_dedup
from corpusloom.llm.source_mix import source_mix
from corpusloom.llm.tokens import token_counts
from corpusloom.llm.url_filter import url_filter

#: The rules that op4's contract names.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Both turns of op6's added conversation.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return read_back(format_records(records_from_turns(rows.unionByName(added))))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_id",
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_learned", F.sha2(secret_text(F.col("base")), 256).alias("base_sha256"),
        secret_text(F.concat("base", "added")).alias("spans"),
    )


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changes=changed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_chat_format": op6_chat_format,
        "op7_source_mix": op7_source_mix,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_pii": op9_pii,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_secret_scan": op11_secret_scan,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP6_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length(role) + length(text)
                + length(text) - length(replace(text, '\', ''))
                + (length(text) - length(replace(text, '###', ''))) // 3
                + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: Cosine links of all pairs in double precision, and the smallest id reachable; brute force, for small tables only.
OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""




def _phrases_sql(longest: int = 5, least: int = 100, top: int = 2000) -> str:
    """op12 over all windows of words."""
    lower_case = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    pieces = f"unnest(regexp_split_to_array({lower_case}, '[.,;:!?\\x0A-\\x0D]'))"
    words = "list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '')"
    window = "unnest(list_transform(range(1, len(ws) - {0} + 2), lambda i: array_to_string(ws[i:i + {0} - 1], ' ')))"
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, phrase, count(*) AS f FROM (SELECT lang, {window.format(k)} AS phrase FROM p WHERE len(ws) >= {k}) GROUP BY lang, phrase HAVING count(*) >= {least}"
        for k in range(1, longest + 1)
    )
    part = lambda a, b: f"array_to_string(string_split(c.phrase, ' ')[{a}:{b}], ' ')"
    cuts = " UNION ALL ".join(f"SELECT c.*, {k} AS k, {part(1, k)} AS x, {part(k + 1, 'c.size')} AS y FROM f c WHERE size > {k}" for k in range(1, longest))
    inner = " UNION ALL ".join(
        f"SELECT lang, f, {part(i + 1, i + m)} AS phrase FROM f c WHERE size = {n}" for n in range(3, longest + 1) for m in range(2, n) for i in range(n - m + 1)
    )
    return f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, {pieces} AS piece FROM documents), p AS (SELECT lang, {words} AS ws FROM t),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang), f AS ({grams}), cuts AS ({cuts}),
scored AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, c.k, CAST(CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM ({inner}) GROUP BY lang, phrase),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
    FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT * FROM ranked WHERE rank <= {top}"""


#: CRC-32 of a short text's bytes, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""


def _merkle_sql(lower: int = 6, upper: int = 2, fan: int = 8) -> str:
    """op13 with one step a level, for at most ``fan ** lower`` rows of a lang and ``fan ** upper`` langs."""
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(one(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower_case = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = []

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            at = f"PARTITION BY t, r // {fan} ORDER BY r ROWS BETWEEN"
            steps.append(f"""{name}{k}s AS (SELECT t, r, coalesce(string_agg(h, '') OVER ({at} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') OVER ({at} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS (SELECT t, r // {fan} AS r, (max(n) + {fan - 1}) // {fan} AS n,
                CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {name}{k} GROUP BY t, r // {fan})""")

    steps.append(f"""a0 AS (SELECT lang AS t, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n, {leaf("text")} AS h,
        {leaf(lower_case)} AS changed FROM documents)""")
    tree("a", lower)
    steps.append(f"b0 AS (SELECT 0 AS t, t AS lang, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h FROM a{lower})")
    tree("b", upper)
    joins, n, m = [], ["a0.n"], ["b0.n"]
    for name, levels, sizes in (("a", lower, n), ("b", upper, m)):
        for k in range(levels):
            joins.append(f"JOIN {name}{k}s ON {name}{k}s.t IS NOT DISTINCT FROM {name}0.t AND {name}{k}s.r = {name}0.r // {fan**k}")
            sizes.append(f"(({sizes[-1]} + {fan - 1}) // {fan})")
    levels = [(f"a{k}s", n[k]) for k in range(lower)] + [(f"b{k}s", m[k]) for k in range(upper)]
    beside = " || ".join(f"CASE WHEN {size} = 1 THEN '' ELSE {s}.l || {s}.g END" for s, size in levels)
    steps.append(f"""f0 AS (SELECT a0.doc_id, a0.h AS leaf, b0.h AS subroot, sha256({beside}) AS proof_sha256,
        CASE WHEN {CRC32_SQL.format("CAST(a0.doc_id AS VARCHAR)")} % 3 = 0 THEN a0.changed ELSE a0.h END AS f,
        {", ".join(f"CASE WHEN {size} > 1 THEN {s}.l END AS l{i}, {s}.g AS g{i}" for i, (s, size) in enumerate(levels))}
        FROM a0 JOIN b0 ON b0.lang IS NOT DISTINCT FROM a0.t {" ".join(joins)})""")
    for i in range(len(levels)):
        steps.append(f"f{i + 1} AS (SELECT * EXCLUDE f, CASE WHEN l{i} IS NULL THEN f ELSE sha256(l{i} || f || g{i}) END AS f FROM f{i})")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{upper}) AS root, proof_sha256, f AS folded_root, f = (SELECT h FROM b{upper}) AS verified FROM f{len(levels)}"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrase_mining": _phrases_sql(), "op13_merkle_manifest": _merkle_sql(), "op5_exact_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_embedding_dedup": OP8_SQL}
