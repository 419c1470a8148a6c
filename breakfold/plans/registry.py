"""Queries by name over calls derived from the order table, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakfold.functions import overlap as ov
from breakfold.functions import parsing, tags
from breakfold.operators import annotate, cluster, export, merge, store
from breakfold.operators.blockpairs import ID_BLOCK, block_pairs
from breakfold.sources import vcf

from .synthetic import CALLS_CTE, LINES_CTE, SOURCES, calls, lines, merge_calls

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; its SQL sees the views ``calls`` and ``lines``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            needs_lines = " lines" in sql
            SQL[name] = f"WITH RECURSIVE {LINES_CTE.replace('calls AS', 'lines AS') if needs_lines else CALLS_CTE}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return add


def _q(spark, d) -> DataFrame:
    return calls(spark, d).select(F.col("idx").alias("qid"), "chrA", "chrB", "posA", "posB", F.col("var").alias("event_type"))


def _store(spark, d) -> DataFrame:
    """Carriers only, as a store holds them."""
    return calls(spark, d).where(~F.col("gt").isin(*store.NOT_CARRIED)).select("var", "chrA", "chrB", "posA", "posB", "sample", "idx")


STORE = "store AS (SELECT * FROM calls WHERE gt NOT IN ('0/0', './.'))"
RATIO = "CAST(least(q.posB, d.posB) - greatest(q.posA, d.posA) + 1 AS DOUBLE) / (greatest(q.posB, d.posB) - least(q.posA, d.posA) + 1)"
DIST = "greatest(abs(q.posA - d.posA), abs(q.posB - d.posB))"
PAIR = "q.chrA = d.chrA AND q.chrB = d.chrB"

# Parsing


@query(
    "parse_calls",
    """, m AS (SELECT *, CASE WHEN var = 'BND' AND k % 3 = 2 THEN 1 ELSE 0 END AS tra FROM lines)
    SELECT k, chrA, chrB, CASE WHEN tra = 1 THEN pa WHEN s1 = s2 THEN least(pa, pb) ELSE posA END AS posA,
           CASE WHEN tra = 1 AND s1 > s2 THEN pa WHEN tra = 1 THEN pb WHEN s1 = s2 THEN greatest(pa, pb) ELSE posB END AS posB, var AS event_type, false AS bad FROM m""",
)
def parse_calls(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_calls(lines(spark, d)).select("k", "chrA", "chrB", "posA", "posB", "event_type", "bad")


@query(
    "parse_info_map",
    """, e AS (SELECT k, unnest(string_split(string_split(line, chr(9))[8], ';')) AS e FROM lines)
    SELECT k, split_part(e, '=', 1) AS key, substr(e, instr(e, '=') + 1) AS value FROM e WHERE contains(e, '=')""",
)
def parse_info_map(spark, d):
    return parsing.split_columns(lines(spark, d)).select("k", F.explode(parsing.info_map(F.col("info"))).alias("key", "value"))


@query(
    "parse_ci",
    """SELECT k, CASE WHEN c % 2 = 0 THEN c % 50 ELSE 0 END AS "ci_A_lower", CASE WHEN c % 2 = 0 THEN c % 70 ELSE 0 END AS "ci_A_upper",
    CASE WHEN c % 3 = 0 THEN c % 30 WHEN c % 2 = 0 THEN c % 50 ELSE 0 END AS "ci_B_lower", CASE WHEN c % 3 = 0 THEN c % 30 WHEN c % 2 = 0 THEN c % 70 ELSE 0 END AS "ci_B_upper" FROM lines""",
)
def parse_ci(spark, d):
    return parsing.split_columns(lines(spark, d)).select("k", *parsing.ci_columns(F.col("info")))


@query("parse_format_map", "SELECT k, gt, CASE WHEN k % 2 = 0 THEN CAST(c % 5 AS STRING) END AS cn, CASE WHEN k % 2 = 0 THEN '.' ELSE CAST(c % 5 AS STRING) END AS dp FROM lines")
def parse_format_map(spark, d):
    m = parsing.format_map(F.col("fmt"), F.col("samples"))
    df = parsing.split_columns(lines(spark, d)).withColumn("m", m)
    return df.select("k", *[F.get(F.try_element_at("m", F.lit(n.upper())), F.lit(0)).alias(n) for n in ("gt", "cn", "dp")])


@query("normalize_chrom", "SELECT k, s1 AS chrom FROM lines")
def normalize_chrom(spark, d):
    return parsing.split_columns(lines(spark, d)).select("k", parsing.normalize_chrom(F.col("raw_chrom")).alias("chrom"))


@query("class_predicates", "SELECT k, chrA <> chrB AS inter, var = 'INS' AS ins, var = 'BND' AS precise FROM calls")
def class_predicates(spark, d):
    return calls(spark, d).select("k", parsing.is_interchromosomal(F.col("chrA"), F.col("chrB")).alias("inter"), parsing.is_insertion(F.col("var")).alias("ins"), parsing.is_precise(F.col("var")).alias("precise"))


@query(
    "tag_functions",
    """SELECT k, CAST(k AS STRING) || '_x_' || CAST(c AS STRING) AS clean, CAST(k AS STRING) || '_x_' || CAST(c AS STRING) || '|' || filter AS tag,
    var AS svtype, CAST(k AS STRING) || '_x_' || CAST(c AS STRING) || '|P|GT:' || gt || '|' ||
    CASE WHEN k % 2 = 0 THEN 'CN:' || CAST(c % 5 AS STRING) || '|DP:.' ELSE 'DP:' || CAST(c % 5 AS STRING) END AS sample_text FROM lines""",
)
def tag_functions(spark, d):
    df = parsing.split_columns(lines(spark, d))
    return df.select(
        "k", tags.sanitize_id(F.col("vid")).alias("clean"), tags.format_tag(F.col("vid"), F.col("filter")).alias("tag"), parsing.retrieve_key(F.col("line"), "SVTYPE").alias("svtype"),
        tags.collect_sample(F.col("vid"), F.col("fmt"), F.col("samples"), F.array(F.lit("P"))).alias("sample_text"),
    )


@query(
    "collect_info",
    """, e AS (SELECT k, c, list_filter(string_split(string_split(line, chr(9))[8], ';'), lambda x: NOT contains(x, ':') AND NOT contains(x, '|')) AS e FROM lines)
    SELECT k, CAST(k AS STRING) || '_x_' || CAST(c AS STRING) || '|' || replace(replace(array_to_string(e, '|'), '=', ':'), ',', ':') AS info_text FROM e""",
)
def collect_info(spark, d):
    return parsing.split_columns(lines(spark, d)).select("k", tags.collect_info(F.col("vid"), F.col("info")).alias("info_text"))


@query(
    "read_bedpe",
    """SELECT k AS db_ord, CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN s1 ELSE s2 END AS "chrA", CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN pa ELSE pb END AS "posA",
    CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN s2 ELSE s1 END AS "chrB", CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN pb ELSE pa END AS "posB", var AS event_type, c % 9 AS occ, CAST(c % 9 AS DOUBLE) / 8 AS frq FROM calls""",
)
def read_bedpe(spark, d):
    return vcf.parse_bedpe(_bedpe_lines(spark, d))


def _bedpe_lines(spark, d):
    return calls(spark, d).select(F.col("k").alias("db_ord"), F.concat_ws(" \t ", "s1", F.col("pa").cast("string"), "s2", F.col("pb").cast("string"), "var", (F.col("c") % 9).cast("string"), ((F.col("c") % 9) / 8).cast("string")).alias("line"))


# Store


@query("pass_filter", "SELECT idx, filter FROM calls WHERE filter IN ('PASS', '.')")
def pass_filter(spark, d):
    return store.pass_filter(calls(spark, d)).select("idx", "filter")


@query(
    "carrier_explode",
    """SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS idx, var, sample, "ci_A_lower" AS lo FROM (SELECT *, CASE WHEN c % 2 = 0 THEN c % 50 ELSE 0 END AS "ci_A_lower" FROM lines) WHERE gt NOT IN ('0/0', './.')""",
)
def carrier_explode(spark, d):
    df = parsing.parse_calls(lines(spark, d).join(calls(spark, d).select("k", "sample"), "k"))
    df = df.withColumns({"source_ord": F.lit(0), "line_no": F.col("k"), "sample_names": F.array("sample"), "source_sample": F.lit("file")})
    return store.numbered(store.carriers(df)).select("idx", "var", "sample", F.col("ci_A_lower").alias("lo"))


@query("sample_antijoin", f", {STORE} SELECT idx, sample FROM calls WHERE sample NOT IN (SELECT sample FROM store)")
def sample_antijoin(spark, d):
    return store.new_samples(calls(spark, d), _store(spark, d)).select("idx", "sample")


@query("distinct_lists", f", {STORE} SELECT DISTINCT 'chrA' AS what, chrA AS value FROM store UNION ALL SELECT DISTINCT 'chrB', chrB FROM store UNION ALL SELECT DISTINCT 'var', var FROM store UNION ALL SELECT DISTINCT 'sample', sample FROM store")
def distinct_lists(spark, d):
    s = _store(spark, d)
    parts = [store.distinct_values(s, c).select(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("chrA", "chrB", "var", "sample")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("max_idx", f", {STORE} SELECT max(idx) AS max_idx FROM store")
def max_idx(spark, d):
    return store.max_idx(_store(spark, d))


@query("db_size", f", {STORE} SELECT count(DISTINCT sample) AS n FROM store")
def db_size(spark, d):
    return store.db_size(_store(spark, d))


@query("partition_fetch", f", {STORE} SELECT idx, posA, posB FROM store WHERE var = 'DEL' AND chrA = '1' AND chrB = '1'")
def partition_fetch(spark, d):
    return store.partition_rows(_store(spark, d), "DEL", "1", "1").select("idx", "posA", "posB")


@query("fetch_by_index", f", {STORE} SELECT idx, var, posA, posB FROM store WHERE idx IN (SELECT k FROM calls WHERE var = 'INV')")
def fetch_by_index(spark, d):
    return store.by_index(_store(spark, d), calls(spark, d).where("var = 'INV'").select("idx")).select("idx", "var", "posA", "posB")


# Predicates and candidates


def _pairs(spark, d, distance, kind=None, within=None, size=1024):
    """Pairs of calls of a type within the distance as idx, other, and what similarity takes; ``kind`` filters the calls."""
    own = calls(spark, d).select("chrA", "chrB", "var", "posA", "posB", "idx")
    own = own.where(kind) if kind else own
    df = block_pairs(own, ["chrA", "chrB", "var"], "posA", "posB", ["idx"], distance, lambda q, r: F.lit(True), within=within, size=size, count=own.count())
    return df.withColumnsRenamed({"l_idx": "idx", "r_idx": "other"}), [F.col(c) for c in ("l_posA", "l_posB", "r_posA", "r_posB")]


BOX = f"calls q JOIN calls d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= 10000 AND abs(q.posB - d.posB) <= 10000 AND q.idx < d.idx"


@query("box_candidates", f"SELECT q.idx, d.idx AS other FROM {BOX}")
def box_candidates(spark, d):
    return _pairs(spark, d, 10_000, size=ID_BLOCK)[0].select("idx", "other")


@query("overlap_ratio", f"SELECT q.idx, d.idx AS other, round({RATIO}, 9) AS ratio FROM {BOX} WHERE q.chrA = q.chrB")
def overlap_ratio(spark, d):
    # Nested calls' ratio is that of their lengths, so in the order of lengths equal ratios lie together.
    df, q = _pairs(spark, d, 10_000, "chrA = chrB", [F.col("posB") - F.col("posA"), "posA", "idx"])
    return df.select("idx", "other", F.round(ov.overlap_ratio(*q), 9).alias("ratio"))


@query("breakpoint_distance", f"SELECT q.idx, d.idx AS other, {DIST} AS distance FROM {BOX} WHERE q.chrA <> q.chrB")
def breakpoint_distance(spark, d):
    df, q = _pairs(spark, d, 10_000, "chrA <> chrB")
    return df.select("idx", "other", ov.breakpoint_distance(*q).alias("distance"))


# Annotation

TABLE_SQL = f""", {STORE}, n AS (SELECT count(DISTINCT sample) AS n FROM store),
h AS (SELECT q.idx, count(DISTINCT d.sample) AS occ FROM calls q JOIN store d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= 10000 AND abs(q.posB - d.posB) <= 10000
      WHERE q.chrA <> q.chrB OR ({RATIO} >= 0.6) GROUP BY 1),
r AS (SELECT c.idx AS qid, coalesce(h.occ, 0) AS occ, coalesce(h.occ, 0) / n.n AS frq FROM calls c LEFT JOIN h USING (idx), n)
SELECT qid, occ, frq FROM r"""


def _table(spark, d, max_frq=1.0):
    return annotate.annotate_table(_q(spark, d), _store(spark, d), max_frq=max_frq)


@query("annotate_table", TABLE_SQL)
def annotate_table(spark, d):
    return _table(spark, d).select("qid", "occ", "frq")


@query("annotate_table_max_frq", TABLE_SQL + " WHERE frq <= 0.05")
def annotate_table_max_frq(spark, d):
    return _table(spark, d, 0.05).select("qid", "occ", "frq")


def _gt_sql(types: str) -> str:
    return f""", h AS (SELECT DISTINCT q.idx, d.gt FROM calls q JOIN calls d ON {PAIR} {types} AND abs(q.posA - d.posA) <= 10000 AND abs(q.posB - d.posB) <= 10000
    WHERE CASE WHEN q.chrA <> q.chrB THEN true WHEN q.var = 'INS' THEN {DIST} <= 50 ELSE {RATIO} >= 0.6 END),
    o AS (SELECT idx, max(CASE WHEN gt <> '0/0' THEN 1 ELSE 0 END) + 1 AS occ FROM h GROUP BY 1)
    SELECT c.idx AS qid, coalesce(o.occ, 0) AS occ, coalesce(o.occ, 0) / 3 AS frq FROM calls c LEFT JOIN o USING (idx)"""


def _gts(spark, d):
    """Each call with three sample columns: its own genotype, a carrier and a phased reference."""
    return calls(spark, d).select("chrA", "chrB", F.col("var").alias("event_type"), "posA", "posB", F.array(F.col("gt"), F.lit("0/1"), F.lit("0|0")).alias("gts"))


@query("annotate_genotypes", _gt_sql("AND q.var = d.var"))
def annotate_genotypes(spark, d):
    return annotate.annotate_genotypes(_q(spark, d), _gts(spark, d), 3).select("qid", "occ", "frq")


@query("annotate_genotypes_no_var", _gt_sql(""))
def annotate_genotypes_no_var(spark, d):
    return annotate.annotate_genotypes(_q(spark, d), _gts(spark, d), 3, no_var=True).select("qid", "occ", "frq")


BEST_SQL = f""", db AS (SELECT *, min(k) OVER (PARTITION BY chrA, chrB, var) AS t FROM calls),
p AS (SELECT q.idx, d.c, row_number() OVER (PARTITION BY q.idx ORDER BY CASE WHEN q.chrA <> q.chrB OR q.var = 'INS' THEN -CAST({DIST} AS DOUBLE) ELSE {RATIO} END DESC, d.t, d.k) AS n
      FROM calls q JOIN db d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= 10000 AND abs(q.posB - d.posB) <= 10000 AND q.k <> d.k
      WHERE CASE WHEN q.chrA <> q.chrB THEN true WHEN q.var = 'INS' THEN {DIST} <= 50 ELSE {RATIO} >= 0.6 END)
SELECT c.idx AS qid, p.c % 9 AS occ, CAST(p.c % 9 AS DOUBLE) / 8 AS frq FROM calls c LEFT JOIN p ON p.idx = c.idx AND p.n = 1"""


@query("annotate_tags_best", BEST_SQL.replace(" AND q.k <> d.k", ""))
def annotate_tags_best(spark, d):
    df = calls(spark, d)
    s = lambda c: c.cast("string")
    db = df.select("chrA", "chrB", "posA", "posB", F.col("var").alias("event_type"), F.col("k").alias("db_ord"), F.concat(F.lit("AC="), s(F.col("c") % 9), F.lit(";AF="), s((F.col("c") % 9) / 8)).alias("info"))
    out = annotate.annotate_best(_q(spark, d), annotate.tag_database(db, "AC", "AF"))
    return out.select("qid", "occ", F.col("frq").cast("double").alias("frq"))


@query(
    "annotate_bedpe",
    BEST_SQL.replace(" AND q.k <> d.k", "")
    .replace("db AS (SELECT *,", "bed AS (SELECT k, c, var, CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN s1 ELSE s2 END AS \"chrA\", CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN pa ELSE pb END AS \"posA\", CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN s2 ELSE s1 END AS \"chrB\", CASE WHEN (s1 = s2 AND pa < pb) OR s1 < s2 THEN pb ELSE pa END AS \"posB\" FROM calls), db AS (SELECT *,")
    .replace("FROM calls),\np AS", "FROM bed),\np AS"),
)
def annotate_bedpe(spark, d):
    return annotate.annotate_best(_q(spark, d), vcf.parse_bedpe(_bedpe_lines(spark, d))).select("qid", "occ", "frq")


@query(
    "annotate_chain",
    f""", {STORE}, h AS (SELECT q.idx, count(DISTINCT d.sample) AS occ FROM calls q JOIN store d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= 10000 AND abs(q.posB - d.posB) <= 10000
      WHERE q.chrA <> q.chrB OR ({RATIO} >= 0.6) GROUP BY 1),
    g AS (SELECT q.idx, count(DISTINCT d.sample) AS occ FROM calls q JOIN store d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= 500 AND abs(q.posB - d.posB) <= 500
      WHERE q.chrA <> q.chrB OR ({RATIO} >= 0.9) GROUP BY 1)
    SELECT c.idx AS qid, 'X' || CASE WHEN h.occ > 0 THEN ';OCC=' || h.occ || ';FRQ=' || h.occ / n.n ELSE '' END || CASE WHEN g.occ > 0 THEN ';NEAR=' || g.occ || ';NFRQ=' || g.occ / n.n ELSE '' END AS info
    FROM calls c LEFT JOIN h USING (idx) LEFT JOIN g USING (idx), (SELECT count(DISTINCT sample) AS n FROM store) n""",
)
def annotate_chain(spark, d):
    s = _store(spark, d)

    def step(occ_tag, frq_tag, overlap, distance):
        def run(df):
            out = annotate.annotate_table(df, s, overlap, distance)
            return out.withColumn("info", annotate.info_with(F.col("info"), F.col("occ"), F.col("frq"), occ_tag, frq_tag)).drop("occ", "frq")

        return run

    return annotate.chain(_q(spark, d).withColumn("info", F.lit("X")), [step("OCC", "FRQ", 0.6, 10_000), step("NEAR", "NFRQ", 0.9, 500)]).select("qid", "info")


# Clustering and export

#: By definition: a row's label is the run of the last core among the rows m - 1 before it and itself.
def _run_sql(m: int, eps: int) -> str:
    return f""", {STORE}, o AS (SELECT *, row_number() OVER (PARTITION BY var, chrA, chrB ORDER BY posA, posB, idx) AS i FROM store),
    x AS (SELECT a.*, coalesce(b.posA - a.posA < {eps}, false) AS core FROM o a LEFT JOIN o b ON a.var = b.var AND a.chrA = b.chrA AND a.chrB = b.chrB AND b.i = a.i + {m - 1}),
    y AS (SELECT x.*, CASE WHEN core THEN sum(CASE WHEN core AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY var, chrA, chrB ORDER BY i) END AS run FROM (SELECT *, lag(core) OVER (PARTITION BY var, chrA, chrB ORDER BY i) AS p FROM x) x),
    z AS (SELECT a.idx, arg_max(b.run, b.i) AS x_label FROM y a LEFT JOIN y b ON a.var = b.var AND a.chrA = b.chrA AND a.chrB = b.chrB AND b.i BETWEEN a.i - {m - 1} AND a.i AND b.core GROUP BY 1)
    SELECT idx, CAST(x_label AS BIGINT) AS x_label FROM z"""


def _runs(spark, d, m, eps):
    return cluster.run_labels(_store(spark, d), cluster.PART, ["posA", "posB", "idx"], "posA", eps, m, "x_label").select("idx", "x_label")


@query("run_labels_m2", _run_sql(2, 500))
def run_labels_m2(spark, d):
    return _runs(spark, d, 2, 500)


@query("run_labels_m3", _run_sql(3, 800))
def run_labels_m3(spark, d):
    return _runs(spark, d, 3, 800)


def _xy_sql(eps_sql: str, m: int = 2) -> str:
    """Labels along posA and then posB, by gaps and islands, which for two points is the same rule."""
    return f""", {STORE}, e AS (SELECT *, {eps_sql} AS eps FROM store),
    g AS (SELECT *, CASE WHEN posA - lag(posA) OVER w < eps THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY var, chrA, chrB ORDER BY posA, posB, idx)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY var, chrA, chrB ORDER BY posA, posB, idx) AS isl FROM g),
    n AS (SELECT *, count(*) OVER (PARTITION BY var, chrA, chrB, isl) AS size FROM i),
    g2 AS (SELECT *, CASE WHEN posB - lag(posB) OVER w < eps THEN 0 ELSE 1 END AS cut2 FROM n WHERE size > 1 WINDOW w AS (PARTITION BY var, chrA, chrB, isl ORDER BY posB, posA, idx)),
    i2 AS (SELECT *, sum(cut2) OVER (PARTITION BY var, chrA, chrB, isl ORDER BY posB, posA, idx) AS isl2 FROM g2),
    n2 AS (SELECT *, count(*) OVER (PARTITION BY var, chrA, chrB, isl, isl2) AS size2 FROM i2),
    lab AS (SELECT n.*, n2.isl2, CASE WHEN n2.size2 > 1 THEN true ELSE false END AS dense FROM n LEFT JOIN n2 USING (idx))"""


@query("dbscan_xy", _xy_sql("500") + " SELECT idx, dense, min(idx) OVER (PARTITION BY var, chrA, chrB, isl, isl2, CASE WHEN dense THEN 0 ELSE idx + 1 END) AS first_idx FROM lab")
def dbscan_xy(spark, d):
    from pyspark.sql import Window

    df = cluster.dbscan_xy(_store(spark, d), 500, 2)
    w = Window.partitionBy(*cluster.PART, "x_label", "y_label")
    dense = F.col("y_label").isNotNull()
    return df.select("idx", dense.alias("dense"), F.when(dense, F.min("idx").over(w)).otherwise(F.col("idx")).alias("first_idx"))


N40 = 40


def _export_sql(keys: str, tail: str) -> str:
    return f"""SELECT * EXCLUDE (a0, a1, b0, b1), {SPANS} FROM (SELECT var, chrA, chrB, {tail} FROM lab GROUP BY var, chrA, chrB, {keys})"""


DENSE_TAIL = """CASE WHEN count(*) = 1 THEN min(posA) ELSE CAST(floor(sum(posA) / count(*)) AS BIGINT) END AS posA, CASE WHEN count(*) = 1 THEN min(posB) ELSE CAST(floor(sum(posB) / count(*)) AS BIGINT) END AS posB,
count(DISTINCT sample) AS occ, count(*) AS n_calls, round(count(DISTINCT sample) / 20, 4) AS frq, min(idx) AS first_idx, min(posA) AS a0, max(posA) AS a1, min(posB) AS b0, max(posB) AS b1"""
#: A cluster's spans around its representative.
SPANS = "-abs(posA - a0) AS ci_pos_low, abs(posA - a1) AS ci_pos_high, -abs(posB - b0) AS ci_end_low, abs(posB - b1) AS ci_end_high"


def _summary(members):
    return export.summarize(members, 20).select("var", "chrA", "chrB", "posA", "posB", "occ", "n_calls", "frq", "first_idx", "ci_pos_low", "ci_pos_high", "ci_end_low", "ci_end_high")


@query("export_dbscan", _xy_sql("500") + _export_sql("isl, isl2, dense, CASE WHEN dense THEN 0 ELSE idx + 1 END", DENSE_TAIL))
def export_dbscan(spark, d):
    return _summary(export.cluster_members(_store(spark, d), dbscan=True))


#: Anchors of ``nodes`` (block b, place i from 1, places ``low`` of the lower neighbours), block by block: a node without an anchor below is one.
WALK = """walk AS (SELECT b, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS anc FROM nodes WHERE i = 1
UNION ALL SELECT w.b, w.i + 1, CASE WHEN list_has_any(w.anc, n.low) THEN w.anc ELSE list_append(w.anc, n.i) END FROM walk w JOIN nodes n ON n.b = w.b AND n.i = w.i + 1),
fin AS (SELECT b, arg_max(anc, i) AS anc FROM walk GROUP BY b)"""


def _star_sql(keep: str = "true") -> str:
    """cl: a row per cluster and member of the calls that ``keep`` holds for; greedy star covers inside density clusters, noise by itself."""
    far = "CASE WHEN q.var = 'INS' THEN 50 ELSE 2500 END"
    return (
        _xy_sql("CASE WHEN var = 'INS' THEN 50 ELSE 2500 END").replace("FROM store),", f"FROM store WHERE {keep}),", 1)
        + f""", d AS (SELECT *, concat_ws('/', var, chrA, chrB, isl, isl2) AS b FROM lab WHERE dense),
    nb AS (SELECT q.b, q.idx, d.idx AS other FROM d q JOIN d ON q.b = d.b AND abs(q.posA - d.posA) <= {far} AND abs(q.posB - d.posB) <= {far} WHERE q.chrA <> q.chrB OR q.var = 'INS' OR {RATIO} >= 0.8),
    deg AS (SELECT d.*, n FROM d JOIN (SELECT idx, count(*) AS n FROM nb GROUP BY 1) USING (idx)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, posA, posB, idx) AS i FROM deg),
    nodes AS (SELECT pl.b, pl.i, pl.idx, coalesce(low, []) AS low FROM pl LEFT JOIN (SELECT x.idx, list(y.i) AS low FROM nb JOIN pl x ON x.idx = nb.idx JOIN pl y ON y.idx = nb.other WHERE y.i < x.i GROUP BY 1) USING (idx)), {WALK},
    ce AS (SELECT n.b, n.idx FROM nodes n JOIN fin USING (b) WHERE list_contains(anc, n.i)),
    cl AS (SELECT s.var, s.chrA, s.chrB, ce.idx AS center, s.idx, s.posA, s.posB, s.sample FROM ce JOIN nb ON nb.idx = ce.idx JOIN store s ON s.idx = nb.other
           UNION ALL SELECT var, chrA, chrB, idx, idx, posA, posB, sample FROM lab WHERE NOT dense),
    su AS (SELECT cl.var, cl.chrA, cl.chrB, center, min(m.posA) AS posA, min(m.posB) AS posB, count(DISTINCT cl.sample) AS occ, count(*) AS n_calls, round(count(DISTINCT cl.sample) / 20, 4) AS frq, min(cl.idx) AS first_idx,
           min(cl.posA) AS a0, max(cl.posA) AS a1, min(cl.posB) AS b0, max(cl.posB) AS b1 FROM cl JOIN store m ON m.idx = cl.center GROUP BY 1, 2, 3, 4),
    summary AS (SELECT * EXCLUDE (a0, a1, b0, b1), {SPANS} FROM su)"""
    )


@query(
    "export_no_merge",
    _star_sql("var = 'INS'") + " SELECT * EXCLUDE (center) FROM summary UNION ALL SELECT var, chrA, chrB, posA, posB, 1, 1, round(1 / 20, 4), idx, 0, 0, 0, 0 FROM store WHERE var <> 'INS'",
)
def export_no_merge(spark, d):
    return _summary(export.no_merge_members(_store(spark, d)))


@query(
    "export_genotypes",
    _xy_sql("500") + """, s AS (SELECT DISTINCT sample FROM store), c AS (SELECT var, chrA, chrB, list(DISTINCT sample) AS hits, min(idx) AS first_idx FROM lab GROUP BY var, chrA, chrB, isl, isl2, dense, CASE WHEN dense THEN 0 ELSE idx + 1 END)
    SELECT c.first_idx, s.sample, CASE WHEN list_contains(c.hits, s.sample) THEN './1' ELSE '0/0' END AS gt FROM c, s""",
)
def export_genotypes(spark, d):
    samples = sorted(store.column(store.distinct_values(_store(spark, d), "sample"), "sample"))
    m = export.cluster_members(_store(spark, d), dbscan=True).groupBy(*export.KEY).agg(F.min("idx").alias("first_idx"), F.collect_set("sample").alias("hits"))
    cols = F.split(tags.genotype_columns(F.lit(samples).cast("array<string>"), F.col("hits")), "\t")
    return m.select("first_idx", F.posexplode(cols).alias("n", "gt")).select("first_idx", F.element_at(F.lit(samples).cast("array<string>"), F.col("n") + 1).alias("sample"), "gt")


@query(
    "neighbor_degree",
    f""", {STORE} SELECT q.idx, count(*) AS degree FROM store q JOIN store d ON {PAIR} AND q.var = d.var AND abs(q.posA - d.posA) <= CASE WHEN q.var = 'INS' THEN 50 ELSE 2500 END
    AND abs(q.posB - d.posB) <= CASE WHEN q.var = 'INS' THEN 50 ELSE 2500 END WHERE q.chrA <> q.chrB OR q.var = 'INS' OR {RATIO} >= 0.8 GROUP BY 1""",
)
def neighbor_degree(spark, d):
    return export.neighbours(_store(spark, d)).groupBy("idx").agg(F.count(F.lit(1)).alias("degree"))


@query("export_star_cover", _star_sql() + " SELECT * EXCLUDE (center) FROM summary")
def export_star_cover(spark, d):
    return _summary(export.cluster_members(_store(spark, d)))


@query(
    "export_lines",
    _star_sql()
    + """, sa AS (SELECT list(DISTINCT sample ORDER BY sample) AS names FROM store),
    li AS (SELECT center, list(DISTINCT sample) AS hits, string_agg('|' || sample || ':' || posA || ':' || posB, '' ORDER BY idx) AS listed FROM cl GROUP BY 1),
    o AS (SELECT summary.*, row_number() OVER (ORDER BY chrA, chrB, var, posA, posB, first_idx, center) - 1 AS n FROM summary)
    SELECT concat_ws(chr(9), chrA, posA, 'cluster_' || n, 'N', CASE WHEN chrA = chrB AND var <> 'BND' THEN '<' || var || '>' ELSE 'N[' || chrB || ':' || posB || '[' END, '.', 'PASS',
           'SVTYPE=' || var || CASE WHEN chrA = chrB AND var <> 'BND' THEN ';END=' || posB || ';SVLEN=' || abs(posA - posB) ELSE '' END || ';NSAMPLES=' || len(names) || ';OCC=' || occ || ';FRQ=' || round(occ / len(names), 4)
           || ';CIPOS=' || ci_pos_low || ',' || ci_pos_high || ';CIEND=' || ci_end_low || ',' || ci_end_high || ';VARIANTS=' || listed, 'GT',
           array_to_string(list_transform(names, lambda x: CASE WHEN list_contains(hits, x) THEN './1' ELSE '0/0' END), chr(9))) AS line
    FROM o JOIN li USING (center), sa""",
)
def export_lines(spark, d):
    s = _store(spark, d)
    return export.lines(export.cluster_members(s), sorted(store.column(store.distinct_values(s, "sample"), "sample"))).select("line")


# Merging

EDGE = f"""e AS (SELECT q.idx AS a, d.idx AS b FROM calls q JOIN calls d ON {PAIR} AND q.var = d.var AND (q.posA, q.c % 3, q.k) < (d.posA, d.c % 3, d.k) AND abs(q.posA - d.posA) <= 2000
WHERE CASE WHEN q.var = 'INS' THEN {DIST} <= 50 WHEN q.chrA <> q.chrB THEN {DIST} <= 2000 ELSE {DIST} <= 2000 AND {RATIO} >= 0.95 END)"""


@query("merge_edges", f", {EDGE} SELECT a, b FROM e")
def merge_edges(spark, d):
    return merge.merge_edges(merge_calls(spark, d)).select("a", "b")


ASSIGN = f""", {EDGE},
ord AS (SELECT *, c % 3 AS o, CASE WHEN posA - lag(posA) OVER (PARTITION BY chrA, chrB, var ORDER BY posA, c % 3, k) > 2000 THEN 1 ELSE 0 END AS jump FROM calls),
blk AS (SELECT *, sum(jump) OVER (PARTITION BY chrA, chrB, var ORDER BY posA, o, k) AS bl FROM ord),
num AS (SELECT k, concat_ws('/', chrA, chrB, var, bl) AS b, row_number() OVER (PARTITION BY chrA, chrB, var, bl ORDER BY posA, o, k) AS i FROM blk),
nodes AS (SELECT num.*, coalesce(low, []) AS low FROM num LEFT JOIN (SELECT e.b AS k, list(n.i) AS low FROM e JOIN num n ON n.k = e.a GROUP BY 1) USING (k)), {WALK},
own AS (SELECT n.k, n.b, CASE WHEN list_has_any(n.low, anc) THEN list_min(list_intersect(n.low, anc)) ELSE n.i END AS ai FROM nodes n JOIN fin USING (b)),
asg AS (SELECT own.k AS call_id, a.k AS anchor_id FROM own JOIN num a ON a.b = own.b AND a.i = own.ai)"""


@query("merge_assign", ASSIGN + " SELECT * FROM asg")
def merge_assign(spark, d):
    return cluster.greedy_merge(merge_calls(spark, d))


#: mem: members of each record, the anchor first; files: each source's record in it, the anchor's own or the last; rec: a row a record.
RECORDS = (
    ASSIGN
    + """, mem AS (SELECT anchor_id, c.*, c % 3 AS o, ['alpha', 'beta', 'gamma'][c % 3 + 1] AS src, 'v' || k AS vid, call_id <> anchor_id AS later,
           'SVTYPE=' || var || ';END=' || pb || ';T' || c % 3 || '=' || c % 7 || ';ANY=' || k AS info, CASE WHEN k % 2 = 0 THEN 'CN' ELSE 'DP' END AS k2,
           row_number() OVER (PARTITION BY anchor_id ORDER BY call_id <> anchor_id, posA, c % 3, k) AS r FROM asg JOIN calls c ON c.k = call_id),
    files AS (SELECT mem.* FROM (SELECT anchor_id, src, CASE WHEN min(r) = 1 THEN 1 ELSE max(r) END AS r FROM mem GROUP BY 1, 2) JOIN mem USING (anchor_id, src, r)),
    cal AS (SELECT anchor_id, list(src ORDER BY r0) AS callers, count(*) AS foundby FROM (SELECT anchor_id, src, min(r) AS r0 FROM mem GROUP BY 1, 2) GROUP BY 1),
    tag AS (SELECT anchor_id, count(*) FILTER (filter IN ('PASS', '.')) AS n_pass, count(*) AS n_all, string_agg(CASE WHEN filter IN ('PASS', '.') THEN '' ELSE 'filterIn' END || src, '-' ORDER BY o) AS parts,
            string_agg(CASE WHEN first THEN info ELSE 'T' || o || '=' || c % 7 END, ';' ORDER BY o) AS info_union, list(k2 ORDER BY o) AS k2s, arg_min(k2, o) AS key1
            FROM (SELECT *, o = min(o) OVER (PARTITION BY anchor_id) AS first FROM files) GROUP BY 1),
    vid AS (SELECT anchor_id, coalesce(string_agg(vid || ':' || src, '|' ORDER BY r) FILTER (later), '') AS varid, count(*) FILTER (later) AS n_later FROM mem GROUP BY 1),
    rec AS (SELECT anchor_id, foundby, concat(list_contains(callers, 'alpha')::INT, list_contains(callers, 'beta')::INT, list_contains(callers, 'gamma')::INT) AS supp_vec,
            CASE WHEN n_pass = 3 THEN 'Intersection' WHEN n_all = 3 AND n_pass = 0 THEN 'FilteredInAll' ELSE parts END AS set_tag, array_to_string(callers, '|') AS origin, varid, n_later, info_union, callers,
            'GT:' || key1 || CASE WHEN len(list_distinct(k2s)) = 2 THEN CASE WHEN key1 = 'CN' THEN ':DP' ELSE ':CN' END ELSE '' END AS fmt FROM cal JOIN tag USING (anchor_id) JOIN vid USING (anchor_id)),
    sv AS (SELECT rec.anchor_id, p.o, CASE WHEN f.k IS NULL THEN './.' || repeat(':.', len(string_split(fmt, ':')) - 1)
            ELSE f.gt || ':' || CASE WHEN split_part(fmt, ':', 2) = f.k2 THEN (f.c % 5)::VARCHAR ELSE '.' END || CASE WHEN split_part(fmt, ':', 3) = '' THEN '' WHEN split_part(fmt, ':', 3) = f.k2 THEN ':' || f.c % 5 ELSE ':.' END END AS value
            FROM rec CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) p LEFT JOIN files f ON f.anchor_id = rec.anchor_id AND f.o = p.o)"""
)


def _merged(spark, d, **kw):
    return merge.merge(merge_calls(spark, d), SOURCES, ["P0", "P1", "P2"], **kw)


@query("merge_support", RECORDS + " SELECT anchor_id, foundby, supp_vec, set_tag, origin, varid FROM rec")
def merge_support(spark, d):
    return _merged(spark, d).select("anchor_id", "foundby", "supp_vec", "set_tag", "origin", "varid")


@query("merge_info_union", RECORDS + " SELECT anchor_id, info_union FROM rec")
def merge_info_union(spark, d):
    return _merged(spark, d).select("anchor_id", "info_union")


@query("merge_format_union", RECORDS + " SELECT anchor_id, fmt, string_agg(value, '|' ORDER BY o) AS sample_values FROM rec JOIN sv USING (anchor_id) GROUP BY 1, 2")
def merge_format_union(spark, d):
    return _merged(spark, d).select("anchor_id", "fmt", F.array_join("sample_values", "|").alias("sample_values"))


def _tag_sql(name: str, value: str) -> str:
    return f"string_agg(';' || src || '_{name}=' || {value}, '' ORDER BY r0)"


@query(
    "merge_lines",
    RECORDS
    + f""", ps AS (SELECT anchor_id, src, min(r) AS r0, string_agg(vid || '|' || s1, ',' ORDER BY r) AS chrom, string_agg(vid || '|' || pa, ',' ORDER BY r) AS pos, string_agg(vid || '|.', ',' ORDER BY r) AS qual,
          string_agg(vid || '|' || filter, ',' ORDER BY r) AS filters, string_agg(vid || '|P' || o || '|GT:' || gt || '|' || k2 || ':' || c % 5, ',' ORDER BY r) AS sample,
          string_agg(vid || '|' || replace(replace(info, ';', '|'), '=', ':'), ',' ORDER BY r) AS info FROM mem GROUP BY 1, 2),
    tags AS (SELECT anchor_id, {_tag_sql("CHROM", "chrom")} || {_tag_sql("POS", "pos")} || {_tag_sql("QUAL", "qual")} || {_tag_sql("FILTERS", "filters")} || {_tag_sql("SAMPLE", "sample")} || {_tag_sql("INFO", "info")} AS per_source FROM ps GROUP BY 1),
    sm AS (SELECT anchor_id, string_agg(value, chr(9) ORDER BY o) AS samples FROM sv GROUP BY 1)
    SELECT anchor_id, concat_ws(chr(9), a.s1, a.pa, a.vid || CASE WHEN n_later > 0 THEN ':' || a.src || '|' || varid ELSE '' END, 'N', '<' || a.var || '>', '.', a.filter,
           info_union || CASE WHEN n_later > 0 THEN ';VARID=' || varid ELSE '' END || ';set=' || set_tag || ';FOUNDBY=' || foundby || per_source || ';origin=' || origin || ';SUPP_VEC=' || supp_vec, fmt, samples) AS line
    FROM rec JOIN mem a USING (anchor_id) JOIN tags USING (anchor_id) JOIN sm USING (anchor_id) WHERE NOT a.later""",
)
def merge_lines(spark, d):
    return _merged(spark, d).select("anchor_id", "line")


@query("merge_output_order", "SELECT k AS anchor_id, CASE WHEN s1 = '2' THEN 1 WHEN s1 = '1' THEN 2 ELSE 3 END AS contig_rank FROM calls")
def merge_output_order(spark, d):
    df = merge_calls(spark, d).select(F.col("call_id").alias("anchor_id"), F.col("raw_chrom").alias("chrom"))
    return merge.output_order(df, ["2", "1"]).select("anchor_id", "contig_rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_table(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
