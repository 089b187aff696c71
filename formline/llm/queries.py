"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import attention_lm, bitpack, byte_bpe, host_rules, license_scan, lyndon_sa, merkle, periodic_runs, phrases, pii_crf, poisson_mix, quality_knn, trie_join

#: Target shares of the mix: the hot source is brought down, the others share the rest evenly.
MIX_WEIGHTS = {"src0": 2.0} | {f"src{i}": 1.0 for i in range(1, 20)}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(_docs(spark, sf_dir))


def op3_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_components(_docs(spark, sf_dir))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix(_docs(spark, sf_dir), MIX_WEIGHTS)
    return mixed.select(
        "doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), F.col("mix_count").cast("long").alias("n_copies"),
        F.col("mix_copy").cast("long").alias("copy_no"), "mix_key", F.md5("text").alias("text_md5"),
    )


OP6_SQL = """
WITH counts AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, CASE WHEN s = 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM counts),
rates AS (SELECT s, coalesce(w / nullif(sum(w) OVER (), 0), 0) * (sum(n) OVER ())::DOUBLE / n AS rate FROM w),
u AS (SELECT d.doc_id, d.source, d.text, r.rate,
        (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '~')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
      FROM documents d JOIN rates r ON coalesce(d.source, '') = r.s),
top AS (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 40)::BIGINT AS k FROM rates),
pmf AS (SELECT s, rate, j, CASE WHEN rate = 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-rate + j * ln(rate) - lgamma(j + 1)) END AS p
        FROM rates, range(0, (SELECT k FROM top) + 1) t(j)),
cdf AS (SELECT s, j, sum(p) OVER (PARTITION BY s ORDER BY j) AS c FROM pmf),
n AS (SELECT u.doc_id, u.source, u.text, u.rate, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(u.source, '') AND cdf.c < u.u) AS k FROM u)
SELECT doc_id, source, round(rate, 9) AS mix_rate, k::BIGINT AS n_copies, c::BIGINT AS copy_no,
       md5('mix-order:' || coalesce(doc_id::VARCHAR, '~') || ':' || c::VARCHAR) AS mix_key, md5(text) AS text_md5
FROM n, unnest(range(1, k + 1)) t(c)
"""


def op7_lyndon_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_sa.remove_repeats(_docs(spark, sf_dir))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(_docs(spark, sf_dir)).drop("redacted")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply(_docs(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 9))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT i, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM w, unnest(range(1, len(w) - 1)) r(p)),
twice AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT i, count(DISTINCT p + k) AS n FROM twice, range(3) s(k) GROUP BY i),
line AS (SELECT i, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT i, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY i),
m AS (SELECT d.i, doc_id, host, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d JOIN w USING (i) LEFT JOIN dup USING (i) LEFT JOIN rep USING (i)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n_docs, sum(base_failed::INT) AS n_failed FROM f GROUP BY host),
p AS (SELECT avg(n_failed / n_docs) AS mean, coalesce(var_samp(n_failed / n_docs), 0) AS v FROM h),
k AS (SELECT mean, CASE WHEN v > 0 THEN greatest(mean * (1 - mean) / v - 1, 2) ELSE 2 END AS k FROM p),
r AS (SELECT host, (n_failed + mean * k) / (n_docs + k) AS host_rate FROM h, k)
SELECT doc_id, f.host, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, round(host_rate, 9) AS host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _planted_period(doc_id: int, words: list[bytes]) -> list[bytes]:
    """One text in ten, by its id's digest, goes on with a period from some word."""
    g, h = divmod(zlib.crc32(b"%d" % doc_id), 10)
    n = len(words)
    if h or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(_docs(spark, sf_dir), rewrite=_planted_period)


def op12_phrase_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM w, unnest(range(1, 5)) s(k), unnest(range(1, len(w) - k + 2)) r(i)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score
  FROM f c, unnest(range(1, c.k)) s(j) JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1 : c.k] WHERE c.k > 1),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT lang, g[s : s + m - 1] AS g, max(f) AS around FROM f, unnest(range(2, k)) t(m), unnest(range(1, k - m + 2)) u(s) WHERE k > 2 GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(g, ' ') AS phrase FROM b LEFT JOIN i USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_docs(spark, sf_dir)).drop("detections")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": op1_quality_knn,
    "op2_merkle": op2_merkle,
    "op3_trie_jaccard": op3_trie_jaccard,
    "op4_attention_lm": op4_attention_lm,
    "op5_bit_packing": op5_bit_packing,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_lyndon_suffix_array": op7_lyndon_suffix_array,
    "op8_pii_crf": op8_pii_crf,
    "op9_host_rules": op9_host_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_filters": op12_phrase_filters,
    "op13_license_rules": op13_license_rules,
}
ORACLE_SQL: dict[str, str] = {"op6_poisson_mixing": OP6_SQL, "op9_host_rules": OP9_SQL, "op12_phrase_filters": OP12_SQL}
