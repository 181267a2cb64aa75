"""One query per operator over the whole ``documents`` table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.llm import bpe, mixing, secret_scan, toxicity
from huntlake.llm.collocations import collocations
from huntlake.llm.common import documents
from huntlake.llm.fingerprints import compared_with_next
from huntlake.llm.ngram_join import near_duplicates
from huntlake.llm.pairwise_quality import quality
from huntlake.llm.prefix_trie import prefix_trie
from huntlake.llm.repetition import quality_rules
from huntlake.llm.sanitise import KINDS, find_personal, printed
from huntlake.llm.substrings import without_repeats
from huntlake.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(documents(spark, sf_dir))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_and_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(printed(F.col("base")), 256).alias("base_sha256"),
                        printed(F.col("spans")).alias("spans"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    found, names = mixing.schedule(docs, mixing.tempered_targets(docs))
    return found.select("doc_id", "source", *[F.col(c).alias(k) for k, c in names.items()])


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))[0]


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLES["op12_collocations"] = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^ \\t]+') AS w FROM docs),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, 1 AS k, w[i] AS w1, NULL AS w2, NULL AS w3, count(*) AS f FROM starts GROUP BY ALL
  UNION ALL SELECT lang, 2, w[i], w[i + 1], NULL, count(*) FROM starts WHERE i < len(w) GROUP BY ALL
  UNION ALL SELECT lang, 3, w[i], w[i + 1], w[i + 2], count(*) FROM starts WHERE i + 1 < len(w) GROUP BY ALL),
one AS (SELECT lang, w1, f FROM counts WHERE k = 1),
two AS (SELECT lang, w1, w2, f FROM counts WHERE k = 2),
three AS (SELECT * FROM counts WHERE k = 3 AND f >= 10),
gone AS (SELECT b.lang, b.w1, b.w2 FROM two b JOIN three c ON b.lang = c.lang AND b.w1 = c.w1 AND b.w2 = c.w2 WHERE 100 * c.f >= 50 * b.f
         UNION SELECT b.lang, b.w1, b.w2 FROM two b JOIN three c ON b.lang = c.lang AND b.w1 = c.w2 AND b.w2 = c.w3 WHERE 100 * c.f >= 50 * b.f),
cut AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two b JOIN one x ON x.lang = b.lang AND x.w1 = b.w1 JOIN one y ON y.lang = b.lang AND y.w1 = b.w2
  WHERE b.f >= 10 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = b.lang AND g.w1 = b.w1 AND g.w2 = b.w2)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 1
  FROM three c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN two y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 2
  FROM three c JOIN two x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN one y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
bytes AS (SELECT i, v FROM bits WHERE k = 8),
crc(c, s, p, v) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 1, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, s, p + 1, xor(crc.v >> 8, bytes.v) FROM crc JOIN bytes ON bytes.i = xor(crc.v & 255, ascii(s[p])) WHERE p <= length(s)),
shared AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE p > length(s)),
own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(text)) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.v[1:h], []), a.v[h + 1:]) AS v
  FROM own a JOIN shared USING (c) LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, v[1:d] AS k, d, d = len(v) AS whole FROM (SELECT c, v, unnest(range(len(v) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].x, '[^ \\t-\\r]+')) END AS saved
  FROM prefixes GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
grown AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (k, d)),
up AS (SELECT k[1:e] AS k, e AS d, saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(d + 1)) AS e FROM grown)),
sums AS (SELECT k, d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM up GROUP BY k, d)
SELECT g.conv_id, g.d::BIGINT AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM grown g JOIN sums USING (k, d) LEFT JOIN nodes p ON p.d = g.d - 1 AND p.k = g.k[1:g.d - 1]"""
