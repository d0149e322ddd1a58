"""The registered queries of the corpus operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@register
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.quality import assess

    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.array_join("reasons", ",").alias("reasons"))


@register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


@register
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.near_dup import cluster

    return cluster(table(spark, sf_dir, "documents"), width=2).drop("text_hash")


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_decontamination"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
       FROM i, unnest(range(1, greatest(len(w) - 8, 2))) AS t(p) WHERE len(w) > 0 AND item_id IS NOT NULL),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw) AS widths, unnest(range(1, len(w) - n + 2)) AS t(p)),
m AS (SELECT DISTINCT doc_id, p, n, g FROM dw SEMI JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
f AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m JOIN iw USING (n, g)),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(ids, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@register
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.language_id import identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = identify(docs, learn_from=~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        "bits", "rejected")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.toxicity import REJECT_FROM, fit, score_column

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, table(spark, sf_dir, "labels"), learn_from=~held_out)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         score_column(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT_FROM).cast("int"))


@register
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.line_dedup import line_report

    found = line_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean", F.lit("")), 256).alias("text_sha256"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@register
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.suffix_dedup import deduplicate

    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.license_scan import per_document

    return per_document(table(spark, sf_dir, "documents"))


@register
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.pivot_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op11_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


@register
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


SHARE = "1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"
ORACLES["op12_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(regexp_extract_all({LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {SHARE.format(n="coalesce(c.n, 0)", total="coalesce(t.total, 0)")} AS p,
             {SHARE.format(n="k.n", total="l.total")} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 200
"""


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM w, unnest([1, 2, 3]) AS u(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT lang, phrase, f.k, a, j, string_split(phrase, ' ') AS p FROM f, unnest(range(1, f.k)) AS u(j)),
x AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * cut.a * cut.a) // (l.a::HUGEINT * r.a) AS score
      FROM cut JOIN f AS l ON l.lang = cut.lang AND l.k = j AND l.phrase = array_to_string(p[1:j], ' ')
      JOIN f AS r ON r.lang = cut.lang AND r.k = cut.k - j AND r.phrase = array_to_string(p[j + 1:cut.k], ' ')),
best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(a) AS ext
           FROM f, unnest([1, 2]) AS u(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase AND best.k = 2
         WHERE ext IS NULL OR 100 * ext < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN s USING (lang) QUALIFY rank <= 2000
"""
