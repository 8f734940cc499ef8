"""The queries of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, hamerly, lloyd, mixing, ngram_jaccard, pii, pu_quality, quality_rules, secret_scan, sentencepiece_bpe, sharding, warc, wrappers
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature mixing of all documents' sources under a repetition limit."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by union-free wrappers of their hosts."""
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules: tokeniser fertility over all documents."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed patterns, and what their contexts lead to."""
    return pii.found(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join by R-trees over count vectors, all documents against all."""
    return ngram_jaccard.joined(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with a random forest's verdicts."""
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, taken as responses."""
    return warc.built(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of all documents by the merge-type prefix table."""
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by positive-unlabelled learning."""
    return pu_quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every query vector, all vectors indexed."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components by three rounds of plain Lloyd over whole numbers."""
    return lloyd.clustered(table(spark, sf_dir, "embeddings"))


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 8 parts of 16 entries, codebooks fitted by six rounds of Hamerly's Lloyd."""
    return hamerly.coded(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of all documents, near equal in bytes."""
    return sharding.assigned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_mixing, op2_wrappers, op3_quality_rules, op4_pii, op5_ngram_jaccard, op6_secrets, op7_warc, op8_sentencepiece, op9_pu_quality, op10_ann, op11_lloyd, op12_hamerly, op13_sharding]
    return {f.__name__: f for f in ops}


#: op5 by its definition: all pairs that share a shingle, their exact overlaps, and who reaches whom.
OP5_SQL = r"""
WITH RECURSIVE
bags AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
each_word AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS place, len(words) AS many FROM bags),
windows AS (SELECT rid, many, place, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM each_word WINDOW o AS (PARTITION BY rid ORDER BY place)),
grams AS (SELECT DISTINCT rid, concat_ws(' ', w1, w2, w3, w4) AS gram FROM windows WHERE w4 IS NOT NULL OR many < 4 AND place = 1),
sizes AS (SELECT b.rid, b.doc_id, count(g.gram) AS n FROM bags b LEFT JOIN grams g USING (rid) GROUP BY ALL),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM common c JOIN sizes x ON x.rid = c.a JOIN sizes y ON y.rid = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
paired AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, p.b FROM reach r JOIN paired p ON p.a = r.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, m.component_id FROM sizes s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id
"""


def _lloyd_sql(rounds: int = 3) -> str:
    """op11 round by round, a row a component; floors of quotients come from whole numbers alone."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)",
        "first AS (SELECT rid, row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), embedding) - 1 AS c FROM kept QUALIFY c < 16)",
        "c0 AS MATERIALIZED (SELECT f.c, x.i, x.v FROM first f JOIN x USING (rid))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT x.rid, c.c, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c ON c.i = x.i GROUP BY x.rid, c.c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY rid)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT a.c, x.i, sum(x.v) AS s, count(*) AS n FROM a{r} a JOIN x USING (rid) GROUP BY a.c, x.i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, CAST(CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.i = c.i)")
    steps.append(f"told AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, t.centroid_sha256 FROM a{rounds} a JOIN kept k USING (rid) JOIN told t ON t.c = a.c"


def _codes_sql(rounds: int = 6) -> str:
    """op12 round by round, a row a component; q is the part."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "flat AS (SELECT rid, len(embedding) // 8 AS size, unnest(range(len(embedding))) AS p, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)",
        "x AS MATERIALIZED (SELECT rid, CAST(p // size AS INT) AS q, CAST(p % size AS INT) AS i, v FROM flat)",
        "first AS (SELECT rid, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS c FROM kept QUALIFY c < 16)",
        "c0 AS MATERIALIZED (SELECT f.c, x.q, x.i, x.v FROM first f JOIN x USING (rid))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT x.rid, x.q, c.c, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c ON c.q = x.q AND c.i = x.i GROUP BY x.rid, x.q, c.c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, q, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY rid, q)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT a.c, x.q, x.i, sum(x.v) AS s, count(*) AS n FROM a{r} a JOIN x USING (rid, q) GROUP BY a.c, x.q, x.i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.q, c.i, CAST(CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.q = c.q AND m.i = c.i)")
    steps.append(f"told AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY q, c, i)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"codes AS (SELECT rid, string_agg(lower(printf('%02x', c)), '' ORDER BY q) AS code, sum(d) AS error FROM a{rounds} GROUP BY rid)")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, z.code, CAST(z.error AS BIGINT) AS error, CAST(sum(z.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, t.codebooks_sha256 FROM codes z JOIN kept k USING (rid), told t"


#: op13 by a running sum over all documents; checksums byte by byte, with the table of the polynomial 0xEDB88320.
OP13_SQL = r"""
WITH RECURSIVE
bits AS (SELECT CAST(range AS UBIGINT) AS b, CAST(range AS UBIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
sized AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, list_concat([CAST(4294967295 AS UBIGINT)], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(concat('0x', h) AS UBIGINT))) AS bytes FROM documents),
sums AS (SELECT doc_id, size, CAST(xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32 FROM sized, crc),
run AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through, sum(size) OVER () AS whole, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS rank FROM sums),
cut AS (SELECT *, CAST((2 * through - size) * 8 // (2 * whole) AS INT) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": OP5_SQL, "op11_lloyd": _lloyd_sql(), "op12_hamerly": _codes_sql(), "op13_sharding": OP13_SQL}
