"""The registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fingerprint, license_scan, mixing, mlm, ngram_join, packing, phrases, quality, secret_scan, suffix_dedup, token_output, vector_codes, vector_join
from quarry.llm._tokens import vocabulary


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_documents(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.matrices(_documents(spark, sf_dir), vocabulary())


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mlm.score(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select(F.col("_carry.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir))


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_embeddings(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(_documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_token_output": op3_token_output,
        "op4_ngram_join": op4_ngram_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm_score": op6_lm_score,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_license_scan": op9_license_scan,
        "op10_fingerprint": op10_fingerprint,
        "op11_vector_join": op11_vector_join,
        "op12_phrases": op12_phrases,
        "op13_vector_codes": op13_vector_codes,
    }


_NGRAM_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""


_VECTOR_JOIN_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
    len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
l AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM (SELECT * FROM v WHERE usable) x JOIN (SELECT * FROM v WHERE usable) y ON len(x.v) = len(y.v) AND x.r <> y.r AND list_cosine_similarity(x.v, y.v) >= 0.9),
c AS (SELECT r, r AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.r),
m AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.root GROUP BY c.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
"""

_PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, g, count(*) AS f FROM (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS g FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(g) = 1 GROUP BY lang),
o AS (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM o WHERE len(g) > 1),
s AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN o x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN o y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, g, max(f) AS f FROM (
  SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM o WHERE len(g) > 2) GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i USING (lang, g) WHERE NOT coalesce(100 * i.f >= 80 * b.a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) QUALIFY rank <= 2000
"""


def _vector_codes_sql() -> str:
    """Rounds are the same step again, so they are written out from one text."""
    assign = "SELECT p.r, p.part, arg_min(c.e, (list_sum(list_transform(list_zip(p.q, c.c), lambda z: (z[1] - z[2]) ** 2))::BIGINT, c.e)) AS e, min(list_sum(list_transform(list_zip(p.q, c.c), lambda z: (z[1] - z[2]) ** 2))::BIGINT) AS d FROM p JOIN c{i} c USING (part) GROUP BY ALL"
    move = """
m{i} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM (
  SELECT part, e, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT p.part, a.e, unnest(p.q) AS x, generate_subscripts(p.q, 1) AS pos FROM p JOIN a{i} a USING (r, part)) GROUP BY ALL) GROUP BY ALL),
c{j} AS (SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (part, e))"""
    steps = "".join(f",\na{i} AS ({assign.format(i=i)}),{move.format(i=i, j=i + 1)}" for i in range(4))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[(part * len(v) // 4 + 1):((part + 1) * len(v) // 4)] AS q FROM k, range(4) t(part)),
c0 AS (SELECT part, r - 1 AS e, q AS c FROM p WHERE r <= 256){steps},
a4 AS ({assign.format(i=4)}),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (r), h
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't say the others: compression, tokenization, training, rounding to copies, spans with positions, bytes of
    UTF-8 and vector hashes are tested against brute force in tests/llm."""
    return {"op4_ngram_join": _NGRAM_JOIN_SQL, "op11_vector_join": _VECTOR_JOIN_SQL, "op12_phrases": _PHRASES_SQL, "op13_vector_codes": _vector_codes_sql()}
