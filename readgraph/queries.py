"""The operators' queries over tables derived from ``orders``, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ALIGNMENTS_SQL, FILTER, GENOME_DUCKDB, GRAPH, READS_SQL, THIN, alignments, reads
from .functions.sequences import percent_identity, rev_comp
from .operators import bubbles, components, filtering, graph, overlaps, paths, reduction, tips, unitigs
from .plans.assembly import assemble, filter_metrics
from .plans.lineage import kept, mark, materialize, new_folder, trim
from .sources.alignments import PAF, parse_paf, read_fastq, read_overlaps, read_paf, write_overlaps
from .sources.sinks import dot_lines, fasta_chunks as fasta_in_chunks, fasta_lines, gfa_chunks as gfa_in_chunks, gfa_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- SQL of the stages


def rc(c: str) -> str:
    return f"concat(substr({c}, 1, length({c}) - 1), CASE right({c}, 1) WHEN '+' THEN '-' ELSE '+' END)"


RATED = """SELECT *, CAST(CAST(CAST(num_matching AS FLOAT) / CAST(alignment_block_length AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE) AS identity FROM alignments"""


def stages(c: int, edges: str = "SELECT * FROM raw_edges") -> str:
    """Common table expressions; DuckDB runs those that a query uses."""
    return f"""WITH RECURSIVE alignments AS ({ALIGNMENTS_SQL}),
rated AS ({RATED}),
skips AS (SELECT *, CASE WHEN query_name = target_name THEN 'self' WHEN least(query_end - query_start, target_end - target_start) < 20 THEN 'length'
                         WHEN identity < 5 THEN 'identity' ELSE 'kept' END AS outcome FROM rated),
passed AS (SELECT * EXCLUDE (outcome) FROM skips WHERE outcome = 'kept'),
best AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY least(query_name, target_name), greatest(query_name, target_name)
                                                         ORDER BY alignment_block_length DESC, line_no) = 1),
sides AS (SELECT line_no, 0 AS side, query_name AS read_name, query_length AS length, query_start AS s, query_end AS e FROM passed
          UNION ALL SELECT line_no, 1, target_name, target_length, target_start, target_end FROM passed),
moves AS (SELECT read_name, pos, sum(d) AS d FROM (SELECT read_name, s AS pos, 1 AS d FROM sides UNION ALL SELECT read_name, e, -1 FROM sides) GROUP BY ALL),
segments AS (SELECT * FROM (SELECT read_name, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM moves
                            WINDOW w AS (PARTITION BY read_name ORDER BY pos)) WHERE "end" IS NOT NULL),
deep AS (SELECT *, CASE WHEN lag("end") OVER w = start THEN 0 ELSE 1 END AS fresh FROM segments WHERE depth > {c} WINDOW w AS (PARTITION BY read_name ORDER BY start)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY read_name ORDER BY start) AS island FROM deep),
runs AS (SELECT read_name, min(start) AS s, max("end") AS e FROM islands GROUP BY read_name, island),
regions AS (SELECT read_name, s AS coverage_start, e AS coverage_end FROM runs QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY e - s DESC, s) = 1),
lengths AS (SELECT read_name, length FROM sides QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY line_no, side) = 1),
stats AS (SELECT l.read_name, l.length, coalesce(r.coverage_start, 0) AS coverage_start, coalesce(r.coverage_end, 0) AS coverage_end, coalesce(d.max_depth, 0) AS max_depth
          FROM lengths l LEFT JOIN regions r USING (read_name) LEFT JOIN (SELECT read_name, max(depth) AS max_depth FROM segments GROUP BY 1) d USING (read_name)),
clip AS (SELECT b.*, greatest(query_start, q.coverage_start) AS b1, least(query_end, q.coverage_end) AS e1, q.coverage_end - q.coverage_start AS l1,
                greatest(target_start, t.coverage_start) AS ts, least(target_end, t.coverage_end) AS te, t.coverage_end - t.coverage_start AS l2
         FROM best b JOIN stats q ON q.read_name = b.query_name JOIN stats t ON t.read_name = b.target_name),
flip AS (SELECT *, CASE WHEN strand = '+' THEN ts ELSE l2 - te END AS b2, CASE WHEN strand = '+' THEN te ELSE l2 - ts END AS e2 FROM clip),
hang AS (SELECT *, least(b1, b2) + least(l1 - e1, l2 - e2) AS o FROM flip),
classified AS (SELECT *, CASE WHEN o > ceil(greatest(e1 - b1, e2 - b2) * CAST(CAST(0.8 AS FLOAT) AS DOUBLE)) THEN 'internal'
                              WHEN b1 <= b2 AND l1 - e1 <= l2 - e2 THEN 'first_contained' WHEN b1 >= b2 AND l1 - e1 >= l2 - e2 THEN 'second_contained'
                              WHEN e1 - b1 + o < 20 OR e2 - b2 + o < 20 THEN 'filtered' ELSE 'proper' END AS cls FROM hang),
contained AS (SELECT DISTINCT CASE cls WHEN 'first_contained' THEN query_name ELSE target_name END AS read_name FROM classified WHERE cls IN ('first_contained', 'second_contained')),
thin AS (SELECT read_name FROM stats WHERE max_depth < {c}),
proper AS (SELECT query_name, target_name,
    CASE WHEN b1 > b2 THEN concat(query_name, '+') ELSE concat(target_name, strand) END AS source_name,
    CASE WHEN b1 > b2 THEN concat(target_name, CASE strand WHEN '+' THEN '-' ELSE '+' END) ELSE concat(query_name, '-') END AS rc_sink_name,
    CASE WHEN b1 > b2 THEN concat(target_name, strand) ELSE concat(query_name, '+') END AS sink_name,
    CASE WHEN b1 > b2 THEN concat(query_name, '-') ELSE concat(target_name, CASE strand WHEN '+' THEN '-' ELSE '+' END) END AS rc_source_name,
    abs(b1 - b2) AS edge_len, CASE WHEN b1 > b2 THEN (l2 - e2) - (l1 - e1) ELSE (l1 - e1) - (l2 - e2) END AS rc_edge_len,
    greatest(e1 - b1, e2 - b2, 0) AS overlap_len, identity FROM classified WHERE cls = 'proper'),
outer_ AS (SELECT * FROM proper WHERE query_name NOT IN (SELECT read_name FROM contained) AND target_name NOT IN (SELECT read_name FROM contained)),
final AS (SELECT * FROM outer_ WHERE query_name NOT IN (SELECT read_name FROM thin) AND target_name NOT IN (SELECT read_name FROM thin)),
raw_edges AS (SELECT source_name AS src, sink_name AS dst, edge_len, overlap_len, identity FROM final
              UNION ALL SELECT rc_sink_name, rc_source_name, rc_edge_len, overlap_len, identity FROM final),
raw_nodes AS (SELECT src AS node_id FROM raw_edges UNION SELECT dst FROM raw_edges),
bounds AS (SELECT src, max(edge_len) AS longest, min(edge_len) AS shortest FROM raw_edges GROUP BY 1),
tri AS (SELECT x.src AS n1, x.dst AS n2, y.dst AS n3, x.edge_len AS l12, y.edge_len AS l23, bx.longest, by_.shortest
        FROM raw_edges x JOIN raw_edges y ON y.src = x.dst JOIN raw_edges z ON z.src = x.src AND z.dst = y.dst
        JOIN bounds bx ON bx.src = x.src JOIN bounds by_ ON by_.src = y.src),
mid AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY l12, n2) AS r FROM (SELECT n1, n2, l12, list(n3) AS far FROM tri WHERE l12 + l23 <= longest + 10 GROUP BY ALL)),
fold AS (SELECT DISTINCT n1, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS gone FROM mid
         UNION ALL SELECT f.n1, f.r + 1, CASE WHEN list_contains(f.gone, m.n2) THEN f.gone ELSE list_distinct(list_concat(f.gone, m.far)) END
         FROM fold f JOIN mid m ON m.n1 = f.n1 AND m.r = f.r + 1),
transitive AS (SELECT n1 AS src, unnest(gone) AS dst FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY n1 ORDER BY r DESC) = 1)
               UNION SELECT n1, n3 FROM tri WHERE l23 < 10 OR l23 = shortest),
superfluous AS (SELECT src, dst FROM transitive UNION SELECT {rc("dst")}, {rc("src")} FROM transitive),
reduced AS (SELECT e.* FROM raw_edges e ANTI JOIN superfluous s ON s.src = e.src AND s.dst = e.dst),
shorts AS (SELECT src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n, floor(max(overlap_len) OVER (PARTITION BY src) * CAST(0.8 AS DOUBLE) + CAST(0.499 AS DOUBLE)) AS least_ FROM reduced)
           WHERE n >= 2 AND overlap_len < least_),
shorts2 AS (SELECT src, dst FROM shorts UNION SELECT dst, src FROM shorts),
trimmed AS (SELECT e.* FROM reduced e ANTI JOIN shorts2 s ON s.src = e.src AND s.dst = e.dst),
twinned AS (SELECT e.* FROM trimmed e SEMI JOIN (SELECT {rc("dst")} AS src, {rc("src")} AS dst FROM trimmed) t ON t.src = e.src AND t.dst = e.dst),
edges AS ({edges}),
ends AS (SELECT src AS node_id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges UNION ALL SELECT node_id, 0, 0 FROM raw_nodes),
degree AS (SELECT node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY 1)
"""


SYMMETRIC = "SELECT * FROM twinned"
UNITIGS = """,
starts AS (SELECT node_id FROM degree WHERE out_degree >= 1 AND NOT (in_degree = 1 AND out_degree = 1)),
links AS (SELECT e.src AS node, e.dst AS next, e.edge_len FROM edges e JOIN degree s ON s.node_id = e.src JOIN degree d ON d.node_id = e.dst
          WHERE s.out_degree = 1 AND d.in_degree = 1 AND d.out_degree <= 1 AND e.src NOT IN (SELECT node_id FROM starts)),
heads AS (SELECT e.src AS start, e.dst AS head, e.edge_len FROM edges e JOIN starts s ON s.node_id = e.src JOIN degree d ON d.node_id = e.dst WHERE d.in_degree = 1 AND d.out_degree <= 1),
chain AS (SELECT start, head, head AS node, CAST(1 AS BIGINT) AS idx FROM heads
          UNION ALL SELECT c.start, c.head, l.next, c.idx + 1 FROM chain c JOIN links l ON l.node = c.node),
rest AS (SELECT * FROM links WHERE node NOT IN (SELECT node FROM chain)),
ring AS (SELECT node AS start, next AS head, node, CAST(0 AS BIGINT) AS idx, next, edge_len FROM rest
         UNION ALL SELECT g.start, g.head, r.node, g.idx + 1, r.next, r.edge_len FROM ring g JOIN rest r ON r.node = g.next WHERE r.node > g.start),
closed AS (SELECT DISTINCT start FROM ring WHERE next = start),
members0 AS (SELECT 0 AS rank, start, head, start AS node_id, CAST(0 AS BIGINT) AS idx, head AS next_id, edge_len FROM heads
             UNION ALL SELECT 0, c.start, c.head, c.node, c.idx, l.next, l.edge_len FROM chain c LEFT JOIN links l ON l.node = c.node
             UNION ALL SELECT 1, start, head, node, idx, next, edge_len FROM ring WHERE start IN (SELECT start FROM closed)),
named AS (SELECT rank, start, head, count(*) AS n_members FROM members0 GROUP BY ALL
          UNION ALL SELECT 2, node_id, '', 0 FROM degree WHERE out_degree = 0 AND node_id NOT IN (SELECT node_id FROM members0)),
ids AS (SELECT *, row_number() OVER (ORDER BY rank, start, head) - 1 AS unitig_id, CASE rank WHEN 0 THEN 'linear' WHEN 1 THEN 'circular' ELSE 'empty' END AS kind FROM named),
members AS (SELECT i.unitig_id, CAST(m.idx AS INT) AS idx, m.node_id, m.next_id, coalesce(m.edge_len, 0) AS edge_len FROM members0 m JOIN ids i USING (rank, start, head)),
owners AS (SELECT node_id, max(unitig_id) AS id FROM members GROUP BY 1),
unitig_edges AS (SELECT a.id AS from_id, b.id AS to_id, min(edge_len) AS edge_len, max(overlap_len) AS overlap_len, max(identity) AS identity
                 FROM edges e JOIN owners a ON a.node_id = e.src JOIN owners b ON b.node_id = e.dst WHERE a.id <> b.id GROUP BY 1, 2),
fastq AS (SELECT * FROM (""" + READS_SQL.replace("{genome}", GENOME_DUCKDB) + """)),
pieces AS (SELECT m.unitig_id, m.idx, CASE WHEN m.next_id IS NULL THEN s ELSE substr(s, 1, CAST(m.edge_len AS INT)) END AS piece
           FROM (SELECT m.*, CASE right(m.node_id, 1) WHEN '-' THEN translate(reverse(f.seq), 'ACGT', 'TGCA') ELSE f.seq END AS s
                 FROM members m JOIN fastq f ON f.read_name = substr(m.node_id, 1, length(m.node_id) - 1)) m),
sequences AS (SELECT i.unitig_id, i.kind, i.n_members, coalesce(p.sequence, '') AS sequence
              FROM ids i LEFT JOIN (SELECT unitig_id, string_agg(piece, '' ORDER BY idx) AS sequence FROM pieces GROUP BY 1) p USING (unitig_id))
"""

S3, S8 = stages(3), stages(8)
REDUCED = stages(3, "SELECT * FROM reduced")
CLEAN = stages(3, SYMMETRIC)

# ---------------------------------------------------------------- data that several queries start from


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = mark(spark)
    found = kept(spark, f"overlaps of {sf_dir}", lambda: overlaps.find_overlaps(alignments(spark, sf_dir), FILTER, stored=True), f"{sf_dir}/orders.parquet")
    trim(spark, since, 0)  # what they were made from
    return found


def _graph(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], graph.Graph]) -> graph.Graph:
    """A step's graph, written once a session and folder, so that a query runs its own operator only."""
    made: list[graph.Graph] = []

    def part(i: int) -> DataFrame:
        if not made:
            made.append(build())
        return made[0][i]

    since = mark(spark)
    found = graph.Graph(*(kept(spark, f"{name} {p} of {sf_dir}", lambda i=i: part(i), f"{sf_dir}/orders.parquet") for i, p in enumerate(("nodes", "edges"))))
    trim(spark, since, 0)
    return found


def _raw(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return _graph(spark, sf_dir, "raw", lambda: graph.build_graph(_overlaps(spark, sf_dir), unique=True))


def _reduced(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return _graph(spark, sf_dir, "reduced", lambda: reduction.reduce_transitive(_raw(spark, sf_dir), GRAPH.fuzz))


def _trimmed(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return _graph(spark, sf_dir, "trimmed", lambda: graph.remove_short_edges(_reduced(spark, sf_dir), GRAPH.short_edge_ratio))


def _clean(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return _graph(spark, sf_dir, "clean", lambda: graph.symmetrize(_trimmed(spark, sf_dir)))


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[unitigs.Unitigs, DataFrame]:
    clean = _clean(spark, sf_dir)
    found = unitigs.compress(clean)
    return found, unitigs.unitig_sequences(found.unitigs, found.members, clean, reads(spark, sf_dir))


# ---------------------------------------------------------------- alignments

NAMES = ", ".join(["line_no", *[n for n, _ in PAF]])


@query(S3 + f"SELECT {NAMES} FROM alignments")
def paf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir)
    return parse_paf(rows.select("line_no", F.concat_ws("\t", *[F.col(n).cast("string") for n, _ in PAF]).alias("value")))


@query(S3 + f"SELECT {', '.join(n for n, _ in PAF)} FROM alignments")
def paf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments, written as PAF files and read from them."""
    path = new_folder(spark, "paf")
    alignments(spark, sf_dir).select(F.concat_ws("\t", *[F.col(n).cast("string") for n, _ in PAF])).write.text(path)
    return read_paf(spark, path).drop("line_no")


@query("SELECT read_name, seq FROM (" + READS_SQL.replace("{genome}", GENOME_DUCKDB) + ")")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads, written as FASTQ files and read from them."""
    path = new_folder(spark, "fastq")
    lines = F.explode(F.array(F.concat(F.lit("@"), F.col("read_name"), F.lit(" x")), F.col("seq"), F.lit("+"), F.regexp_replace("seq", ".", "I")))
    reads(spark, sf_dir).select(lines).write.text(path)
    return read_fastq(spark, path)


@query(S3 + "SELECT outcome, count(*) AS n FROM skips GROUP BY 1")
def paf_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.filter_counts(alignments(spark, sf_dir), FILTER)


@query(S3 + "SELECT line_no, identity FROM rated")
def percent_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("line_no", percent_identity(F.col("num_matching"), F.col("alignment_block_length")).alias("identity"))


@query(S3 + f"SELECT {NAMES}, identity FROM best")
def best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.best_alignments(filtering.passing(alignments(spark, sf_dir), FILTER))


@query(S3 + 'SELECT read_name, start, "end", depth FROM segments')
def coverage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.depth_segments(filtering.passing(alignments(spark, sf_dir), FILTER))


@query(S3 + "SELECT read_name, coverage_start, coverage_end FROM regions")
def covered_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.covered_regions(filtering.depth_segments(filtering.passing(alignments(spark, sf_dir), FILTER)), FILTER.min_overlap_count)


@query(S3 + "SELECT * FROM stats")
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.read_stats(filtering.passing(alignments(spark, sf_dir), FILTER), FILTER.min_overlap_count)


@query(S3 + "SELECT line_no, b1, e1, l1, b2, e2, l2, cls FROM classified")
def classify_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.classified_alignments(alignments(spark, sf_dir), FILTER, stored=True)[0].select("line_no", "b1", "e1", "l1", "b2", "e2", "l2", "cls")


@query(S3 + "SELECT cls, count(*) AS n FROM classified GROUP BY 1")
def classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.classified_alignments(alignments(spark, sf_dir), FILTER, stored=True)[0].groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query(S3 + "SELECT read_name FROM contained")
def contained_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.contained_reads(overlaps.classified_alignments(alignments(spark, sf_dir), FILTER, stored=True)[0])


@query(S8 + "SELECT read_name FROM thin")
def low_coverage_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = filtering.passing(alignments(spark, sf_dir), THIN)
    return overlaps.low_coverage_reads(filtering.coverage(passed, THIN.min_overlap_count), THIN.min_overlap_count)


@query(S3 + "SELECT * FROM final")
def proper_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.find_overlaps(alignments(spark, sf_dir), FILTER, stored=True)


@query(S3 + "SELECT * FROM final")
def overlaps_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps, written to a file and read from it."""
    path = new_folder(spark, "overlaps-file")
    write_overlaps(_overlaps(spark, sf_dir), path)
    return read_overlaps(spark, path)


@query(S8 + "SELECT * FROM final")
def proper_overlaps_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.find_overlaps(alignments(spark, sf_dir), THIN, stored=True)


@query(S3 + "SELECT query_name AS read_name FROM final UNION SELECT target_name FROM final")
def unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.unique_reads(overlaps.find_overlaps(alignments(spark, sf_dir), FILTER, stored=True))


@query(
    S3
    + """SELECT 'filter' AS stage, 0 AS iteration, outcome AS name, count(*) AS value FROM skips GROUP BY outcome
UNION ALL SELECT 'classify', 0, cls, count(*) FROM classified GROUP BY cls
UNION ALL SELECT 'filter', 0, 'reads', count(*) FROM stats
UNION ALL SELECT 'overlaps', 0, 'after_containment', count(*) FROM outer_
UNION ALL SELECT 'overlaps', 0, 'unique_reads', count(*) FROM (SELECT query_name FROM outer_ UNION SELECT target_name FROM outer_)
UNION ALL SELECT 'overlaps', 0, 'final', count(*) FROM final"""
)
def filtering_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_metrics(alignments(spark, sf_dir), FILTER, stored=True)


# ---------------------------------------------------------------- graph


@query(S3 + "SELECT * FROM raw_edges")
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(_overlaps(spark, sf_dir), unique=True).edges


@query(S3 + "SELECT a.n AS nodes, b.n AS edges, a.n / b.n AS ratio FROM (SELECT count(*) AS n FROM raw_nodes) a, (SELECT count(*) AS n FROM raw_edges) b")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_summary(_raw(spark, sf_dir))


@query(stages(3, "SELECT * FROM trimmed") + f"SELECT 'edge' AS kind, concat(e.src, ' ', e.dst) AS id FROM edges e ANTI JOIN (SELECT {rc('dst')} AS src, {rc('src')} AS dst FROM edges) t ON t.src = e.src AND t.dst = e.dst")
def sync_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sync_violations(_trimmed(spark, sf_dir))


@query(
    REDUCED
    + """SELECT 'in' AS direction, in_degree AS degree, count(*) AS n_nodes FROM degree GROUP BY 2
UNION ALL SELECT 'out', out_degree, count(*) FROM degree GROUP BY 2"""
)
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_distribution(_reduced(spark, sf_dir))


@query(REDUCED + "SELECT count(*) FILTER (WHERE in_degree = 1 AND out_degree = 1) AS compressible, count(*) AS total, count(*) FILTER (WHERE in_degree = 1 AND out_degree = 1) / count(*) AS fraction FROM degree")
def compressible_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compressible_stats(_reduced(spark, sf_dir))


@query(S3 + "SELECT node_id, in_degree, out_degree FROM degree WHERE in_degree > 1 OR out_degree > 1 ORDER BY in_degree + out_degree DESC, node_id LIMIT 25")
def branching_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.branching_topk(_raw(spark, sf_dir), 25)


LABELS = """, both_ways AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
labels(node, label) USING KEY (node) AS (
  SELECT node_id, node_id FROM raw_nodes
  UNION SELECT x.v, min(l.label) FROM labels l JOIN both_ways x ON x.u = l.node JOIN recurring.labels o ON o.node = x.v WHERE l.label < o.label GROUP BY x.v)
"""


@query(stages(3, SYMMETRIC) + LABELS + "SELECT label AS component, count(*) AS size FROM labels GROUP BY 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    label = components.components(clean.edges.select("src", "dst").union(clean.nodes.select("node_id", "node_id")))
    return label.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


@query(
    CLEAN
    + """, walk AS (SELECT node_id AS start, node_id AS at, 0 AS length, true AS going FROM degree WHERE in_degree = 0
  UNION ALL SELECT w.start, e.dst, w.length + 1, d.in_degree = 1 FROM walk w JOIN degree s ON s.node_id = w.at JOIN edges e ON e.src = w.at JOIN degree d ON d.node_id = e.dst
  WHERE w.going AND s.out_degree = 1 AND w.length < 50)
SELECT start AS node_id, CAST(max(length) AS BIGINT) AS length FROM walk GROUP BY 1"""
)
def tip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.tip_lengths(_clean(spark, sf_dir), 50)


@query(S3 + "SELECT src, dst FROM transitive")
def transitive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.transitive_edges(_raw(spark, sf_dir).edges, GRAPH.fuzz)


@query(S3 + "SELECT * FROM reduced")
def reduce_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.reduce_transitive(_raw(spark, sf_dir), GRAPH.fuzz).edges


@query(CLEAN + "SELECT * FROM twinned")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetrize(_trimmed(spark, sf_dir)).edges


MULTI = """, loose AS (SELECT src, dst, edge_len, overlap_len, identity FROM (
    SELECT source_name AS src, sink_name AS dst, edge_len, overlap_len, identity FROM proper
    UNION ALL SELECT rc_sink_name, rc_source_name, rc_edge_len, overlap_len, identity FROM proper)),
doubled AS (SELECT * FROM loose UNION ALL SELECT src, dst, edge_len + 1, overlap_len - edge_len % 3, identity FROM loose WHERE (edge_len + overlap_len) % 7 = 0),
several AS (SELECT src, dst FROM doubled GROUP BY 1, 2 HAVING count(*) > 1),
gone AS (SELECT dst AS src, src AS dst FROM several UNION SELECT {d}, {s} FROM several UNION SELECT {s}, {d} FROM several),
single AS (SELECT * FROM doubled QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY overlap_len DESC, identity DESC, edge_len) = 1),
left_ AS (SELECT e.* FROM single e ANTI JOIN gone g ON g.src = e.src AND g.dst = e.dst)
SELECT e.* FROM left_ e SEMI JOIN (SELECT {d} AS src, {s} AS dst FROM left_) t ON t.src = e.src AND t.dst = e.dst""".format(d=rc("dst"), s=rc("src"))


@query(S3 + MULTI)
def multi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a graph in which some edges have a second one beside them, as pipeline graphs have none."""
    found = overlaps.proper_overlaps(overlaps.classified_alignments(alignments(spark, sf_dir), FILTER, stored=True)[0])
    edge = lambda s, d, n: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(n).alias("edge_len"), "overlap_len", "identity")
    loose = materialize(found.select(F.explode(F.array(edge("source_name", "sink_name", "edge_len"), edge("rc_sink_name", "rc_source_name", "rc_edge_len"))).alias("e")).select("e.*"), "loose")
    more = loose.filter("(edge_len + overlap_len) % 7 = 0").select("src", "dst", F.col("edge_len") + 1, F.col("overlap_len") - F.col("edge_len") % 3, "identity")
    nodes = loose.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return graph.remove_multi_edges(graph.Graph(nodes, loose.union(more))).edges


@query(REDUCED + "SELECT src, dst FROM shorts")
def short_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.short_edges(_reduced(spark, sf_dir), GRAPH.short_edge_ratio)


@query(REDUCED + "SELECT * FROM trimmed")
def remove_short_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remove_short_edges(_reduced(spark, sf_dir), GRAPH.short_edge_ratio).edges


@query(REDUCED + "SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY identity DESC, edge_len, dst) > 1")
def weak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_edges(_reduced(spark, sf_dir))


@query(
    REDUCED
    + """, weak AS (SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY identity DESC, edge_len, dst) > 1),
weak2 AS (SELECT src, dst FROM weak UNION SELECT dst, src FROM weak)
SELECT e.* FROM edges e ANTI JOIN weak2 w ON w.src = e.src AND w.dst = e.dst"""
)
def remove_weak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remove_weak_edges(_reduced(spark, sf_dir)).edges


@query(stages(3, "SELECT * FROM reduced WHERE overlap_len >= 170") + "SELECT node_id FROM degree WHERE in_degree = 0 AND out_degree = 0")
def singleton_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = _reduced(spark, sf_dir)
    return graph.singleton_nodes(reduced._replace(edges=reduced.edges.filter("overlap_len >= 170")))


@query(
    CLEAN
    + f""", outs AS (SELECT src AS node_id, count(*) AS n, min(dst) AS target FROM edges GROUP BY 1),
kinds AS (SELECT r.node_id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, o.target FROM raw_nodes r LEFT JOIN outs o USING (node_id) LEFT JOIN outs i ON i.node_id = {rc("r.node_id")})
SELECT node_id FROM kinds WHERE n_in = 0 AND n_out = 1 AND target NOT IN (SELECT node_id FROM kinds WHERE n_in = 1 AND n_out = 1)"""
)
def tip_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.tip_nodes(_clean(spark, sf_dir), GRAPH.max_tip_len)


@query(
    CLEAN
    + """, run AS (SELECT e.dst AS head, e.dst AS at, 1 AS n FROM edges e JOIN degree b ON b.node_id = e.src JOIN degree d ON d.node_id = e.dst
    WHERE b.out_degree >= 2 AND d.in_degree = 1 AND d.out_degree = 1
  UNION ALL SELECT r.head, e.dst, r.n + 1 FROM run r JOIN edges e ON e.src = r.at JOIN degree d ON d.node_id = e.dst WHERE d.in_degree = 1 AND d.out_degree = 1 AND r.n < 60),
whole AS (SELECT r.head FROM run r JOIN edges e ON e.src = r.at JOIN degree d ON d.node_id = e.dst WHERE r.n <= 40 AND d.out_degree >= 2)
SELECT DISTINCT r.at AS node_id FROM run r WHERE r.head IN (SELECT head FROM whole) AND r.n <= 40"""
)
def internal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.internal_chains(_clean(spark, sf_dir), 40)


def without(gone: str) -> str:
    """Edges of which neither end, on either strand, is among the nodes ``gone`` (node_id)."""
    return f""", gone AS (SELECT node_id FROM {gone} UNION SELECT {rc("node_id")} FROM {gone})
SELECT e.* FROM edges e ANTI JOIN gone a ON a.node_id = e.src ANTI JOIN gone b ON b.node_id = e.dst"""


KINDS = f""", outs AS (SELECT src AS node_id, count(*) AS n, min(dst) AS target FROM edges GROUP BY 1),
kinds AS (SELECT r.node_id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, o.target FROM raw_nodes r LEFT JOIN outs o USING (node_id) LEFT JOIN outs i ON i.node_id = {rc("r.node_id")}),
tip AS (SELECT node_id FROM kinds WHERE n_in = 0 AND n_out = 1 AND target NOT IN (SELECT node_id FROM kinds WHERE n_in = 1 AND n_out = 1))"""


@query(CLEAN + KINDS + without("tip"))
def trim_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tips.trim_tips(_clean(spark, sf_dir), GRAPH.max_tip_len).edges


@query(CLEAN + ", branching AS (SELECT node_id FROM degree WHERE out_degree > 1)" + without("branching"))
def drop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph without its branching reads."""
    clean = _clean(spark, sf_dir)
    return graph.drop_nodes(clean, bubbles.bubble_sources(clean)).edges


@query(
    CLEAN
    + f""", branching AS (SELECT node_id FROM degree WHERE out_degree > 1), cut AS (SELECT node_id FROM branching UNION SELECT {rc("node_id")} FROM branching),
left_ AS (SELECT * FROM edges ANTI JOIN cut a ON a.node_id = src ANTI JOIN cut b ON b.node_id = dst),
linked AS (SELECT src AS node_id FROM left_ WHERE src <> dst UNION SELECT dst FROM left_ WHERE src <> dst),
nodes AS (SELECT node_id FROM raw_nodes ANTI JOIN cut USING (node_id)),
single AS (SELECT node_id FROM nodes ANTI JOIN linked USING (node_id))
SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM single UNION SELECT {rc("node_id")} FROM single)"""
)
def remove_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that are left when branching reads, and then singletons, are gone."""
    clean = _clean(spark, sf_dir)
    return graph.remove_singletons(graph.drop_nodes(clean, bubbles.bubble_sources(clean))).nodes


@query(
    CLEAN
    + f""", run AS (SELECT e.dst AS head, e.dst AS at, 1 AS n FROM edges e JOIN degree b ON b.node_id = e.src JOIN degree d ON d.node_id = e.dst
    WHERE b.out_degree >= 2 AND d.in_degree = 1 AND d.out_degree = 1
  UNION ALL SELECT r.head, e.dst, r.n + 1 FROM run r JOIN edges e ON e.src = r.at JOIN degree d ON d.node_id = e.dst WHERE d.in_degree = 1 AND d.out_degree = 1 AND r.n < 60),
whole AS (SELECT r.head FROM run r JOIN edges e ON e.src = r.at JOIN degree d ON d.node_id = e.dst WHERE r.n <= 40 AND d.out_degree >= 2),
chain AS (SELECT DISTINCT r.at AS node_id FROM run r WHERE r.head IN (SELECT head FROM whole) AND r.n <= 40)"""
    + without("chain")
)
def cut_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cut_internal(_clean(spark, sf_dir), 40).edges


@query(
    CLEAN
    + """, reach AS (SELECT DISTINCT dst AS start, dst AS node, 0 AS depth FROM edges WHERE src IN (SELECT node_id FROM degree WHERE out_degree > 1)
  UNION SELECT r.start, e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.depth < 8)
SELECT start, node, min(depth) AS depth FROM reach GROUP BY 1, 2"""
)
def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the targets of branching nodes reach within eight edges, as the search for bubbles does."""
    clean = _clean(spark, sf_dir)
    starts = clean.edges.join(bubbles.bubble_sources(clean).withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("start")).distinct()
    return bubbles.reached(starts, clean.edges, 8).select("start", "node", "depth")


@query(CLEAN + "SELECT src, dst FROM edges")
def biloop_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cut_biloops(_clean(spark, sf_dir)).edges.select("src", "dst")


@query(CLEAN + "SELECT src AS node_id FROM edges GROUP BY 1 HAVING count(*) >= 2")
def bubble_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles.bubble_sources(_clean(spark, sf_dir))


@query()
def remove_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles.bubble_nodes(_trimmed(spark, sf_dir), GRAPH.max_bubble_length, GRAPH.min_support_ratio)


@query()
def remove_bubbles_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``remove_bubbles``, with all neighbourhoods worked off by joins, as those are that are too large for a task."""
    return bubbles.bubble_nodes(_trimmed(spark, sf_dir), GRAPH.max_bubble_length, GRAPH.min_support_ratio, split_edges=0)


# ---------------------------------------------------------------- unitigs and files


@query(CLEAN + UNITIGS + "SELECT unitig_id, idx, node_id, coalesce(next_id, '') AS next_id, edge_len FROM members")
def unitig_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.compress(_clean(spark, sf_dir)).members.fillna("", ["next_id"]).fillna(0, ["edge_len"])


@query(CLEAN + UNITIGS + "SELECT kind, count(*) AS n, CAST(sum(n_members) AS BIGINT) AS n_members FROM ids GROUP BY 1")
def unitig_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.compress(_clean(spark, sf_dir)).unitigs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_members").alias("n_members"))


CONTENDED = """,
single AS (SELECT dst, min(src) AS src FROM edges GROUP BY dst HAVING count(*) = 1),
simple AS (SELECT node_id FROM degree WHERE in_degree = 1 AND out_degree = 1),
way AS (SELECT d.node_id, i.src AS met FROM degree d JOIN single i ON i.dst = d.node_id WHERE d.in_degree = 1 AND d.out_degree >= 2
        UNION ALL SELECT w.node_id, i.src FROM way w JOIN simple s ON s.node_id = w.met JOIN single i ON i.dst = w.met),
begun AS (SELECT node_id, met AS start FROM way WHERE met NOT IN (SELECT node_id FROM simple)),
hops AS (SELECT node_id, start, 1 AS n FROM begun WHERE start < node_id
         UNION ALL SELECT h.node_id, b.start, h.n + 1 FROM hops h JOIN begun b ON b.node_id = h.start WHERE b.start < b.node_id),
contended AS (SELECT b.node_id, b.start, coalesce(h.n, 0) % 2 = 1 AS swallowed FROM begun b LEFT JOIN (SELECT node_id, max(n) AS n FROM hops GROUP BY 1) h USING (node_id))
"""


@query(CLEAN + CONTENDED + "SELECT node_id, start, swallowed FROM contended")
def contended_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two orders of unitigs differ: nodes that branch after a single edge in, and whether a walk in order of nodes swallows them."""
    return unitigs.contended_nodes(_clean(spark, sf_dir))


SEQUENTIAL = CONTENDED + """,
starts AS (SELECT node_id FROM degree WHERE out_degree >= 1 AND NOT (in_degree = 1 AND out_degree = 1) AND node_id NOT IN (SELECT node_id FROM contended WHERE swallowed)),
ended AS (SELECT node_id FROM degree WHERE in_degree = 1 AND out_degree <= 1 UNION SELECT node_id FROM contended WHERE swallowed),
links AS (SELECT e.src AS node, e.dst AS next, e.edge_len FROM edges e WHERE e.src IN (SELECT node_id FROM simple) AND e.dst IN (SELECT node_id FROM ended)),
heads AS (SELECT e.src AS start, e.dst AS head, e.edge_len FROM edges e WHERE e.src IN (SELECT node_id FROM starts) AND e.dst IN (SELECT node_id FROM ended)),
chain AS (SELECT start, head, head AS node, CAST(1 AS BIGINT) AS idx FROM heads
          UNION ALL SELECT c.start, c.head, l.next, c.idx + 1 FROM chain c JOIN links l ON l.node = c.node),
late AS (SELECT e.src AS start, e.dst AS head, e.dst AS node, 0 AS place FROM edges e JOIN contended c ON c.node_id = e.src AND c.swallowed JOIN degree d ON d.node_id = e.dst AND d.in_degree = 1 AND d.out_degree <= 1
         UNION ALL SELECT t.start, t.head, l.next, t.place + 1 FROM late t JOIN links l ON l.node = t.node JOIN degree d ON d.node_id = l.next AND d.out_degree <= 1),
parts AS (SELECT *, min(node) OVER (PARTITION BY start, head ORDER BY place) AS own FROM late),
held AS (SELECT p.own, p.node, row_number() OVER (PARTITION BY p.start, p.head, p.own ORDER BY p.place) - 1 AS idx, e.dst AS next, e.edge_len FROM parts p JOIN edges e ON e.src = p.node),
rest AS (SELECT * FROM links WHERE node NOT IN (SELECT node FROM chain UNION ALL SELECT node FROM late)),
ring AS (SELECT node AS start, next AS head, node, CAST(0 AS BIGINT) AS idx, next, edge_len FROM rest
         UNION ALL SELECT g.start, g.head, r.node, g.idx + 1, r.next, r.edge_len FROM ring g JOIN rest r ON r.node = g.next WHERE r.node > g.start),
closed AS (SELECT DISTINCT start FROM ring WHERE next = start),
members0 AS (SELECT 0 AS rank, start, head, start AS node_id, CAST(0 AS BIGINT) AS idx, head AS next_id, edge_len FROM heads
             UNION ALL SELECT 0, c.start, c.head, c.node, c.idx, l.next, l.edge_len FROM chain c LEFT JOIN links l ON l.node = c.node
             UNION ALL SELECT 1, start, head, node, idx, next, edge_len FROM ring WHERE start IN (SELECT start FROM closed)
             UNION ALL SELECT 1, h.own, f.next, h.node, h.idx, h.next, h.edge_len FROM held h JOIN held f ON f.own = h.own AND f.idx = 0),
named AS (SELECT rank, start, head, count(*) AS n_members FROM members0 GROUP BY ALL
          UNION ALL SELECT 2, node_id, '', 0 FROM degree WHERE out_degree = 0 AND node_id NOT IN (SELECT node_id FROM members0) AND node_id NOT IN (SELECT node FROM parts WHERE own <> node)),
ids AS (SELECT *, row_number() OVER (ORDER BY rank, start, head) - 1 AS unitig_id FROM named)
SELECT i.unitig_id, CAST(m.idx AS INT) AS idx, m.node_id, coalesce(m.next_id, '') AS next_id, coalesce(m.edge_len, 0) AS edge_len FROM members0 m JOIN ids i USING (rank, start, head)"""


@query(CLEAN + SEQUENTIAL)
def sequential_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the unitigs that a walk in ascending order of nodes gives."""
    return unitigs.compress(_clean(spark, sf_dir), "sequential").members.fillna("", ["next_id"]).fillna(0, ["edge_len"])


@query(CLEAN + UNITIGS + "SELECT * FROM unitig_edges")
def unitig_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.compress(_clean(spark, sf_dir)).edges


@query(CLEAN + UNITIGS + "SELECT * FROM sequences")
def unitig_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir)[1]


@query(CLEAN + UNITIGS + "SELECT unitig_id, concat('>unitig_', unitig_id, ' len=', length(sequence), 'bp', chr(10), sequence) AS line FROM sequences")
def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta_lines(_sequences(spark, sf_dir)[1])


@query(
    CLEAN
    + UNITIGS
    + """SELECT 0 AS section, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, concat('H', chr(9), 'VN:Z:1.0') AS line
UNION ALL SELECT 1, unitig_id, 0, concat('S', chr(9), 'unitig_', unitig_id, chr(9), sequence) FROM sequences
UNION ALL SELECT 2, from_id, to_id, concat('L', chr(9), 'unitig_', from_id, chr(9), '+', chr(9), 'unitig_', to_id, chr(9), '+', chr(9), overlap_len, 'M') FROM unitig_edges"""
)
def gfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sequences = _sequences(spark, sf_dir)
    return gfa_lines(sequences, found.edges)


#: Bases of a row in the queries of chunks, as the unitigs of these tables are short.
PART = 50
CHUNKS = f"""chunks AS (SELECT unitig_id, part, substr(sequence, part * {PART} + 1, {PART}) AS text
           FROM (SELECT *, unnest(range((length(sequence) + {PART} - 1) // {PART})) AS part FROM sequences)),
line_ends AS (SELECT *, (length(sequence) + {PART} - 1) // {PART} AS part FROM sequences)"""


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[unitigs.Unitigs, DataFrame]:
    clean = _clean(spark, sf_dir)
    found = unitigs.compress(clean)
    return found, materialize(unitigs.sequence_chunks(found.members, clean, reads(spark, sf_dir), PART), "chunks")


@query(CLEAN + UNITIGS + ", " + CHUNKS + " SELECT * FROM chunks")
def sequence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of unitigs in parts, so that no row grows with a unitig's length."""
    return _chunks(spark, sf_dir)[1]


@query(
    CLEAN
    + UNITIGS
    + ", "
    + CHUNKS
    + """ SELECT * FROM chunks UNION ALL SELECT unitig_id, -1, concat('>unitig_', unitig_id, ' len=', length(sequence), 'bp', chr(10)) FROM sequences
UNION ALL SELECT unitig_id, part, chr(10) FROM line_ends"""
)
def fasta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chunks = _chunks(spark, sf_dir)
    return fasta_in_chunks(found.unitigs, chunks)


@query(
    CLEAN
    + UNITIGS
    + ", "
    + CHUNKS
    + """ SELECT 0 AS section, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, concat('H', chr(9), 'VN:Z:1.0', chr(10)) AS text
UNION ALL SELECT 1, unitig_id, -1, concat('S', chr(9), 'unitig_', unitig_id, chr(9)) FROM sequences
UNION ALL SELECT 1, unitig_id, part, text FROM chunks UNION ALL SELECT 1, unitig_id, part, chr(10) FROM line_ends
UNION ALL SELECT 2, from_id, to_id, concat('L', chr(9), 'unitig_', from_id, chr(9), '+', chr(9), 'unitig_', to_id, chr(9), '+', chr(9), overlap_len, 'M', chr(10)) FROM unitig_edges"""
)
def gfa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chunks = _chunks(spark, sf_dir)
    return gfa_in_chunks(found.unitigs, chunks, found.edges)


@query(
    CLEAN
    + """SELECT 0 AS section, a, '' AS b, line FROM (VALUES ('0', 'digraph OverlapGraph {'), ('1', '  rankdir=LR;'), ('2', '  node [shape=box fontname="Helvetica"];'),
                                                              ('3', '  edge [fontname="Helvetica"];'), ('4', '')) t(a, line)
UNION ALL SELECT 2, '0', '', '' UNION ALL SELECT 4, '0', '', '}'
UNION ALL SELECT 1, node_id, '', concat('  "', node_id, '" [style=filled fillcolor=', CASE WHEN out_degree = 0 THEN 'gray' WHEN out_degree = 1 THEN 'black' WHEN out_degree = 2 THEN 'blue'
                                                                                      WHEN out_degree <= 5 THEN 'orange' ELSE 'red' END, ' ];') FROM degree
UNION ALL SELECT 3, src, dst, concat('  "', src, '" -> "', dst, '";') FROM edges"""
)
def dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot_lines(_clean(spark, sf_dir))


@query("SELECT read_name, translate(reverse(seq), 'ACGTNacgtn', 'TGCANTGCAN') AS rc FROM (" + READS_SQL.replace("{genome}", GENOME_DUCKDB) + ")")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_name", rev_comp(F.col("seq")).alias("rc"))


@query()
def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the whole pipeline removed, and what it left."""
    return assemble(_overlaps(spark, sf_dir), GRAPH, stored=True).metrics


@query()
def assembled_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unitigs of the whole pipeline, with their sequences."""
    done = assemble(_overlaps(spark, sf_dir), GRAPH, stored=True)
    return unitigs.unitig_sequences(done.unitigs.unitigs, done.unitigs.members, done.graph, reads(spark, sf_dir))
