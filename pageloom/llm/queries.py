"""Queries of this subpackage, each over its whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import chat, decontaminate, embedding, jaccard, language, licenses, mixing, pii, secrets, suffix
from pageloom.llm.shared import table
from pageloom.llm.tokens import WORD_SQL


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage: item, longest run, places."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no ratings: conversations lend each other turns, from different places on. Masks are written as begin:end."""
    out = chat.formatted(chat.lent(table(spark, sf_dir, "conversations")))
    marks = {m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), " ") for m in ("chosen_mask", "rejected_mask")}
    return out.withColumnRenamed("id", "conv_id").withColumns(marks)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector: its class and how many vectors it is linked to; copies aren't expanded into pairs."""
    return embedding.near(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class and how many documents it is linked to; copies aren't expanded into pairs."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_suffix_dedup, op3_pii, op4_preference, op5_license_scan, op6_embedding_near, op7_secret_scan, op8_language_id, op9_jaccard_join, op10_mixing)
}
QUERIES["pipeline"] = corpus_pipeline.run


def _secret_sql() -> str:
    parts = []
    for name, pattern, fold in secrets.RULES:
        found = f"regexp_extract_all(text, '{'(?i)' if fold else ''}{pattern}')"
        parts.append(f"SELECT doc_id, '{name}' AS rule, unnest(range(len({found})))::INT AS ordinal, unnest({found}) AS secret FROM documents")
    return "\nUNION ALL ".join(parts)


def _shown(side: str) -> str:
    return f"array_to_string(list_transform({side}, lambda t: '{chat.OPEN}' || t.role || chr(10) || t.text || '{chat.CLOSE}' || chr(10)), '')"


def _marked(side: str) -> str:
    """Spans of the speaker's turns: each begins behind all turns before it and its own head."""
    size = f"length(u.role) + length(u.text) + {len(chat.OPEN + chat.CLOSE) + 2}"
    begin = f"coalesce(list_sum(list_transform({side}[1 : i - 1], lambda u: {size})), 0)::INT + {len(chat.OPEN) + 1} + length({side}[i].role)"
    spans = f"list_transform(list_filter(range(1, len({side}) + 1), lambda i: {side}[i].role = '{chat.SPEAKER}'), lambda i: ({begin}) || ':' || ({begin} + length({side}[i].text) + {len(chat.CLOSE)}))"
    return f"array_to_string({spans}, ' ')"


def _license_sql() -> str:
    """All windows of all texts, by brute force over the places of templates' shingles."""
    rows, size = [], licenses.SHINGLE
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        w = re.findall("[0-9a-z_]+", text.lower())
        grams = {" ".join(w[p : p + size]) for p in range(len(w) - size + 1)}
        n = len(grams)
        rows += [f"({k}, '{name}', {n}, {licenses.Index.window(n)}, {licenses.Index.stride(n)}, '{g}')" for g in sorted(grams)]
    return f"""
WITH t(k, license, n, width, stride, gram) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {size}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - {size - 1})) AS p FROM d)),
m AS (SELECT doc_id, k, license, n, p, width, stride, gram FROM g JOIN t USING (gram)),
e AS (SELECT doc_id, k FROM m GROUP BY doc_id, k, n HAVING count(DISTINCT gram) >= {licenses.CONTAINMENT} * n),
s AS (SELECT m.*, unnest(range(greatest(0, ((p - width) // stride + 1) * stride), p + 1, stride)) AS start FROM m JOIN e USING (doc_id, k)),
c AS (SELECT doc_id, license, start, count(DISTINCT gram) / n::DOUBLE AS share FROM s WHERE start + width > p GROUP BY doc_id, k, license, n, start)
SELECT doc_id, license, round(share, 6) AS containment, start::INT AS first_word FROM c WHERE share >= {licenses.CONTAINMENT} - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY share DESC, start) = 1"""


_N, _LEAST = decontaminate.MIN_WORDS, decontaminate.LEAST_WORDS
SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark),
dn AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {_N}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - {_N - 1})) AS p FROM d)),
bn AS (SELECT item_id, p, array_to_string(w[p + 1 : p + {_N}], ' ') AS gram FROM (SELECT item_id, w, unnest(range(len(w) - {_N - 1})) AS p FROM b)),
hit AS (SELECT doc_id, item_id, dn.p AS x, bn.p AS y FROM dn JOIN bn USING (gram)),
island AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS run FROM hit),
short AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS gram FROM b WHERE len(w) >= {_LEAST} AND len(w) < {_N}),
sn AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM short)))
SELECT doc_id, item_id, (count(*) + {_N - 1})::INT AS match_words, min(x)::INT AS doc_word, min(y)::INT AS item_word FROM island GROUP BY doc_id, item_id, x - y, run
UNION SELECT doc_id, item_id, n::INT, p::INT, 0 FROM sn JOIN short USING (gram, n)""",
    "op2_suffix_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {suffix.WORDS}], ' ')) AS gram
 FROM (SELECT doc_id, w, unnest(range(len(w) - {suffix.WORDS - 1})) AS p FROM d)),
r AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS least, max(doc_id) OVER (PARTITION BY gram) AS most FROM g),
f AS (SELECT DISTINCT doc_id, p + k AS word, doc_id <> least AS cut
 FROM (SELECT *, unnest(range({suffix.WORDS})) AS k FROM r WHERE least <> most)),
o AS (SELECT doc_id, word, bool_or(cut) AS cut FROM f GROUP BY doc_id, word),
i AS (SELECT *, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS run FROM o)
SELECT doc_id, min(word)::INT AS first_word, count(*)::INT AS words, count(*) FILTER (cut)::INT AS cut_words FROM i GROUP BY doc_id, run""",
    "op4_preference": f"""
WITH t AS (SELECT DISTINCT conv_id AS id, turn, coalesce(role, 'unknown') AS role,
 replace(replace(coalesce(text, ''), '{chat.OPEN}', '<| turn|>'), '{chat.CLOSE}', '<| end|>') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
v AS (SELECT id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS m FROM t GROUP BY id),
a AS (SELECT id, m, list_filter(range(1, len(m) + 1), lambda i: m[i].role = '{chat.SPEAKER}') AS own FROM v),
k AS (SELECT id, m, own[id % len(own) + 1] AS place FROM a WHERE len(own) > 0),
p AS (SELECT id, m, place, count(*) OVER (PARTITION BY id >> {chat.NEIGHBOURS}) AS n,
 coalesce(lead(m[place:]) OVER w, first_value(m[place:]) OVER w) AS other FROM k WINDOW w AS (PARTITION BY id >> {chat.NEIGHBOURS} ORDER BY id)),
s AS (SELECT id, m AS c, CASE WHEN n > 1 THEN list_concat(m[1 : place - 1], other) ELSE m[1 : place - 1] END AS r FROM p),
x AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS shared FROM s),
y AS (SELECT id, shared, c[1 : shared] AS b, c[shared + 1 :] AS c, r[shared + 1 :] AS r FROM x WHERE shared < len(c) OR shared < len(r))
SELECT id AS conv_id, shared::INT AS shared_turns, {_shown("b")} AS prompt, {_shown("c")} AS chosen, {_marked("c")} AS chosen_mask, {_shown("r")} AS rejected, {_marked("r")} AS rejected_mask FROM y""",
    "op5_license_scan": _license_sql(),
    "op6_embedding_near": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS v, b.vec_id AS w FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= {embedding.THRESHOLD}),
r AS (SELECT vec_id AS v, vec_id AS w FROM embeddings UNION SELECT r.v, l.w FROM r JOIN l ON l.v = r.w)
SELECT r.v AS vec_id, min(r.w) AS class_id, (SELECT count(*) FROM l WHERE l.v = r.v) AS links FROM r GROUP BY r.v""",
    "op7_secret_scan": _secret_sql(),
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + {jaccard.N}], ' ') AS gram
 FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {jaccard.N - 1}))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE o::DOUBLE / (p.n + q.n - o) >= {jaccard.THRESHOLD}),
e AS (SELECT a AS v, b AS w FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS w FROM documents UNION SELECT r.v, e.w FROM r JOIN e ON e.v = r.w)
SELECT r.v AS doc_id, min(r.w) AS class_id, (SELECT count(*) FROM e WHERE e.v = r.v) AS links FROM r GROUP BY r.v""",
    "op10_mixing": f"""
WITH per AS (SELECT source, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))::BIGINT AS tokens FROM documents GROUP BY source),
raw AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, {mixing.ALPHA}) ELSE 0 END AS raw FROM per),
rates AS (SELECT source, (sum(tokens) OVER ())::DOUBLE * (raw / sum(raw) OVER ()) / tokens AS rate FROM raw WHERE tokens > 0),
n AS (SELECT d.*, floor(rate)::INT + (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::INT AS n
 FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INT AS copy FROM n""",
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
