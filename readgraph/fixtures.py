"""Tables of the data model, derived from ``orders`` by SQL that Spark and DuckDB read alike.

Each order is a read on a synthetic contig of 4,000 bases, 250 orders a contig; even contigs are circular.
So the number of components grows with the table, and coverage doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import FilterConfig, GraphConfig
from .plans.lineage import kept

FILTER = FilterConfig(min_overlap_length=20, min_overlap_count=3, min_percent_identity=5.0, overhang_ratio=0.8)
#: A second setting, at which some reads are thinly covered.
THIN = FilterConfig(min_overlap_length=20, min_overlap_count=8, min_percent_identity=5.0, overhang_ratio=0.8)
GRAPH = GraphConfig(max_bubble_length=100, min_support_ratio=1.02, max_tip_len=4, fuzz=10, cleanup_iterations=2, short_edge_ratio=0.8)

ALIGNMENTS_SQL = """
WITH reads AS (
  SELECT concat('r', CAST(o_orderkey AS STRING)) AS read_name, o_orderkey AS k,
         CAST(floor(o_orderkey / 250.0) AS BIGINT) AS chrom,
         (o_orderkey * 7919 + 104729 * (o_orderkey % 17)) % 4000 AS gpos,
         170 + (o_orderkey * 31) % 60 AS len,
         CASE WHEN (o_orderkey * 13) % 7 < 4 THEN 0 ELSE 1 END AS rev
  FROM orders
  WHERE NOT ((o_orderkey * 7919 + 104729 * (o_orderkey % 17)) % 4000 BETWEEN 3000 AND 3399
             AND o_orderkey % 4 <> 0)),
shifts AS (SELECT -4000 AS sh UNION ALL SELECT 0 UNION ALL SELECT 4000),
shifted AS (SELECT r.*, r.gpos + s.sh AS spos FROM reads r CROSS JOIN shifts s
            WHERE s.sh = 0 OR r.chrom % 2 = 0),
pairs AS (
  SELECT a.read_name AS qn, b.read_name AS tn, a.k AS qk, b.k AS tk, a.len AS ql, b.len AS tl,
         a.gpos AS qg, b.spos AS tg, a.rev AS qr, b.rev AS tr,
         greatest(a.gpos, b.spos) AS gs, least(a.gpos + a.len, b.spos + b.len) AS ge,
         (a.k * 31 + b.k * 17) % 1009 AS h
  FROM reads a JOIN shifted b
    ON a.chrom = b.chrom AND a.k < b.k AND a.gpos < b.spos + b.len AND b.spos < a.gpos + a.len
  WHERE NOT (a.gpos BETWEEN 1000 AND 1500 AND b.gpos BETWEEN 1000 AND 1500
             AND a.k % 3 <> b.k % 3 AND a.k % 3 < 2 AND b.k % 3 < 2)),
trimmed AS (
  SELECT pairs.*, gs + h % 4 AS s, ge - h % 3 AS e
  FROM pairs WHERE ge - gs >= 20 AND h % 211 <> 0),
main AS (
  SELECT qn, ql, CASE WHEN qr = 0 THEN s - qg ELSE ql - (e - qg) END AS qs,
         CASE WHEN qr = 0 THEN e - qg ELSE ql - (s - qg) END AS qe,
         CASE WHEN qr = tr THEN '+' ELSE '-' END AS strand,
         tn, tl, CASE WHEN tr = 0 THEN s - tg ELSE tl - (e - tg) END AS ts,
         CASE WHEN tr = 0 THEN e - tg ELSE tl - (s - tg) END AS te,
         CASE WHEN h % 97 = 0 THEN 1 ELSE (e - s) - h % 11 END AS nm, e - s AS abl,
         qk, tk, 1 AS src, h FROM trimmed),
allrows AS (
  SELECT * FROM main
  UNION ALL SELECT tn, tl, ts, te, strand, qn, ql, qs, qe, nm, abl + h % 3 - 1, qk, tk, 2, h
            FROM main WHERE h % 5 = 0
  UNION ALL SELECT a.read_name, a.len, 60, 105, '+', b.read_name, b.len, 62, 107, 44, 45, a.k, b.k, 3, 0
            FROM reads a JOIN reads b ON b.k = a.k + 97 AND a.chrom = b.chrom WHERE a.k % 3 = 0
  UNION ALL SELECT a.read_name, a.len, a.len - 70, a.len, '+', b.read_name, b.len, 0, 70, 66, 70, a.k, b.k, 4, 0
            FROM reads a JOIN reads b ON b.k = a.k + 101 AND a.chrom = b.chrom WHERE a.k % 29 = 0
  UNION ALL SELECT read_name, len, 0, len, '+', read_name, len, 0, len, len, len, k, k, 5, 0
            FROM reads WHERE k % 50 = 0)
SELECT (qk * 10000000 + tk) * 10 + src AS line_no,
       qn AS query_name, ql AS query_length, qs AS query_start, qe AS query_end, strand,
       tn AS target_name, tl AS target_length, ts AS target_start, te AS target_end,
       nm AS num_matching, abl AS alignment_block_length, 60 AS mapq
FROM allrows
"""

READS_SQL = """
WITH chunks AS (
  SELECT c.chrom, k.i, translate(md5(concat(CAST(c.chrom AS STRING), ':', CAST(k.i AS STRING))),
                                 '0123456789abcdef', 'ACGTACGTACGTACGT') AS s
  FROM (SELECT DISTINCT CAST(floor(o_orderkey / 250.0) AS BIGINT) AS chrom FROM orders) c
  CROSS JOIN (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS i FROM orders WHERE o_orderkey < 125) k), {genome},
reads AS (
  SELECT concat('r', CAST(o_orderkey AS STRING)) AS read_name, o_orderkey AS k,
         CAST(floor(o_orderkey / 250.0) AS BIGINT) AS chrom,
         (o_orderkey * 7919 + 104729 * (o_orderkey % 17)) % 4000 AS gpos,
         170 + (o_orderkey * 31) % 60 AS len,
         CASE WHEN (o_orderkey * 13) % 7 < 4 THEN 0 ELSE 1 END AS rev
  FROM orders
  WHERE NOT ((o_orderkey * 7919 + 104729 * (o_orderkey % 17)) % 4000 BETWEEN 3000 AND 3399
             AND o_orderkey % 4 <> 0))
SELECT r.read_name, CASE WHEN r.rev = 0 THEN substr(concat(g.s, g.s), CAST(r.gpos AS INT) + 1, CAST(r.len AS INT)) ELSE translate(reverse(substr(concat(g.s, g.s), CAST(r.gpos AS INT) + 1, CAST(r.len AS INT))), 'ACGT', 'TGCA') END AS seq
FROM reads r JOIN genome g ON g.chrom = r.chrom
"""
#: Ordered concatenation, the one step that the dialects write differently.
GENOME_SPARK = "genome AS (SELECT chrom, array_join(transform(array_sort(collect_list(struct(i, s))), x -> x.s), '') AS s FROM chunks GROUP BY chrom)"
GENOME_DUCKDB = "genome AS (SELECT chrom, string_agg(s, '' ORDER BY i) AS s FROM chunks GROUP BY chrom)"


def _from_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are written once a session and folder: the range join that makes them is no part of any operator."""
    return kept(spark, f"alignments of {sf_dir}", lambda: _from_orders(spark, sf_dir, ALIGNMENTS_SQL), f"{sf_dir}/orders.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_name, seq``, written once a session and folder."""
    return kept(spark, f"reads of {sf_dir}", lambda: _from_orders(spark, sf_dir, READS_SQL.replace("{genome}", GENOME_SPARK)), f"{sf_dir}/orders.parquet")
