"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import bpe, exact, extract, importance, jaccard, lattice, lines, mixing, negatives, neighbours, personal, repeats, toxicity

W = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def remainder(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir), k=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x AS doc_id, x AS node FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS owner FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, p + unnest(range(0, 50)) AS i FROM win JOIN first USING (h) WHERE owner < doc_id
), each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal.personal_data(documents(spark, sf_dir))
    names = F.array(*map(F.lit, personal.KINDS))
    base = F.filter("spans", lambda s: s["base"])

    def told(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(_of_kind(base, i)).cast("long").alias(f"n_{k}") for i, k in enumerate(personal.KINDS)]
    return out.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _of_kind(spans: F.Column, kind: int) -> F.Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, p, concat_ws(chr(10), ls[p + 1], ls[p + 2], ls[p + 3]) AS k
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w
), gone AS (
  SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS i FROM r WHERE rn > 1
), each AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM l
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id,
       CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(4) == 2
    out = toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix_plan(documents(spark, sf_dir), weights=(5, 2, 1), times=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact.dedup(docs, exact.halves(docs))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_lattice_score(spark: SparkSession, sf_dir: str, pieces: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    out = lattice.score(documents(spark, sf_dir), remainder(10) != 0, public_tokenizers.path(pieces))
    return out.withColumn("held_out", ~F.col("learned")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    rows = bpe.coded(documents(spark, sf_dir), public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=5, least=20, n=3, buckets=10_000, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# the CRC-32 of the features' bytes is folded bit by bit from its polynomial
OP11_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, false AS asked, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 0, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT id, asked, array_to_string(w[i:i + k], ' ') AS g, count(*) AS n
  FROM (SELECT id, asked, w, k, unnest(range(1, greatest(len(w) - k, 0) + 1)) AS i FROM t, range(3) r(k)) GROUP BY ALL
), c AS (
  SELECT g, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, CAST(i + 1 AS INTEGER), 2))::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), 4294967295::BIGINT), 4294967295) % 10000 AS b
  FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f))
), fb AS (
  SELECT id, asked, b, sum(n) AS n FROM f JOIN c USING (g) GROUP BY ALL
), m AS (
  SELECT b, coalesce(sum(n) FILTER (asked), 0)::DOUBLE AS t, coalesce(sum(n) FILTER (NOT asked), 0)::DOUBLE AS s FROM fb GROUP BY b
), a AS (
  SELECT sum(t) AS t, sum(s) AS s FROM m
), g AS (
  SELECT b, floor(1000 * ln((m.t + 1) * (a.s + 10000) / ((m.s + 1) * (a.t + 10000)))) AS gain FROM m, a
), d AS (
  SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM fb JOIN g USING (b) WHERE NOT asked GROUP BY id
), s AS (
  SELECT t.id AS doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) >= 20 AS able,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || t.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM t LEFT JOIN d ON d.doc_id = t.id WHERE NOT asked
), p AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS all_ FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * all_ // 100 THEN place END AS rank FROM p
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, k=10, low=30, high=90)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_personal_data": op3_personal_data,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_source_mixing": op6_source_mixing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_lattice_score": op8_lattice_score,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_html_extraction": op12_html_extraction,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op13_hard_negatives": OP13_SQL}
