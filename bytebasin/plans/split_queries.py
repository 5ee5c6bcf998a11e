"""Queries of ranks, limits, samples and splits on orders as timed samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.operators import ranking as rk
from bytebasin.operators import splits as sp
from bytebasin.operators import stats as st
from bytebasin.registry import query
from bytebasin.sources import tables as tb

T = f"WITH {tb.TIMED_SQL}"
#: Counts by largest remainder for shares .6, .2, .2 of any n, in SQL.
COUNTS = """, e AS (SELECT count(*) AS n, count(*) * 0.6 AS a, count(*) * 0.2 AS b FROM timed),
f AS (SELECT n, CAST(floor(a + 1e-9) AS BIGINT) AS fa, CAST(floor(b + 1e-9) AS BIGINT) AS fb, a - floor(a + 1e-9) AS ra, b - floor(b + 1e-9) AS rb FROM e),
g AS (SELECT *, n - fa - 2 * fb AS left_over, CASE WHEN ra >= rb THEN 1 ELSE 3 END AS rank_a, CASE WHEN ra >= rb THEN 2 ELSE 1 END AS rank_b FROM f),
c AS (SELECT n, fa + CAST(left_over >= rank_a AS BIGINT) AS ca, fb + CAST(left_over >= rank_b AS BIGINT) AS cb FROM g)"""
SPLIT = ' SELECT idx, CASE WHEN rank < ca THEN 0 WHEN rank < ca + cb THEN 1 ELSE 2 END AS split FROM ranked, c'
SHARES = (0.6, 0.2, 0.2)


def _named(df: DataFrame) -> DataFrame:
    return df.select("idx", "split")


@query(T + COUNTS + ", ranked AS (SELECT idx, row_number() OVER (ORDER BY md5('7:' || idx), idx) - 1 AS rank FROM timed)" + SPLIT)
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(sp.random_split(tb.timed_samples(spark, sf_dir), SHARES, seed=7))


@query(T + COUNTS + ", ranked AS (SELECT idx, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed)" + SPLIT)
def split_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(sp.temporal_split(tb.timed_samples(spark, sf_dir), SHARES))


@query(T + COUNTS + """, k AS (SELECT count(*) FILTER (WHERE label = 0) AS k0, count(*) FILTER (WHERE label = 1) AS k1 FROM timed),
s AS (SELECT unnest([0, 1, 2]) AS split), w AS (SELECT split, CASE split WHEN 0 THEN ca WHEN 1 THEN cb ELSE n - ca - cb END AS want, k0, k1, n FROM s, c, k),
x AS (SELECT *, CAST(k0 AS DOUBLE) / n * want AS x0, CAST(k1 AS DOUBLE) / n * want AS x1 FROM w),
y AS (SELECT *, CAST(floor(x0 + 1e-9) AS BIGINT) AS f0, CAST(floor(x1 + 1e-9) AS BIGINT) AS f1 FROM x),
z AS (SELECT *, f0 + CASE WHEN x0 - f0 >= x1 - f1 THEN want - f0 - f1 ELSE 0 END AS t0, f1 + CASE WHEN x0 - f0 >= x1 - f1 THEN 0 ELSE want - f0 - f1 END AS t1 FROM y),
q AS (SELECT split, sum(t0) OVER (ORDER BY split) - t0 AS lo0, CASE split WHEN 2 THEN k0 ELSE sum(t0) OVER (ORDER BY split) END AS hi0, sum(t1) OVER (ORDER BY split) - t1 AS lo1, CASE split WHEN 2 THEN k1 ELSE sum(t1) OVER (ORDER BY split) END AS hi1 FROM z),
ranked AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || idx), idx) - 1 AS rank FROM timed)
SELECT idx, split FROM ranked JOIN q ON CASE WHEN label = 0 THEN rank >= lo0 AND rank < hi0 ELSE rank >= lo1 AND rank < hi1 END""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(sp.stratified_split(tb.timed_samples(spark, sf_dir), SHARES, seed=3))


#: Places of one split in each class: (label, lo, hi) of ``{name}`` from what ``{left}`` has, in SQL.
TAKE = """, {name}_x AS (SELECT label, avail, pos0, w * {want} AS x FROM {left}, c), {name}_f AS (SELECT *, least(CAST(floor(x + 1e-9) AS BIGINT), avail) AS fl, x - floor(x + 1e-9) AS r FROM {name}_x),
{name}_m AS (SELECT *, (SELECT {want} FROM c) - (SELECT sum(fl) FROM {name}_f) - coalesce(sum(avail - fl) OVER (ORDER BY r DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing FROM {name}_f),
{name} AS (SELECT label, pos0 AS lo, pos0 + fl + least(greatest(missing, 0), avail - fl) AS hi, avail FROM {name}_m),
{name}_left AS (SELECT t.label, t.avail - (t.hi - t.lo) AS avail, t.hi AS pos0, w FROM {name} t JOIN wanted USING (label))"""
THREE = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
TAKEN = TAKE.format(name="tr", left="wanted", want="ca") + TAKE.format(name="vl", left="tr_left", want="cb") + TAKE.format(name="ts", left="vl_left", want="(n - ca - cb)")


@query(T + COUNTS + f""", three AS (SELECT CAST(o_orderkey AS BIGINT) AS idx, {THREE} AS label FROM orders),
wanted AS (SELECT label, count(*) AS avail, CAST(0 AS BIGINT) AS pos0, CASE label WHEN 0 THEN 0.5 ELSE 0.25 END AS w FROM three GROUP BY label){TAKEN},
q AS (SELECT 0 AS split, * FROM tr UNION ALL SELECT 1, * FROM vl UNION ALL SELECT 2, * FROM ts),
ranked AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY md5('4:' || idx), idx) - 1 AS rank FROM three)
SELECT r.idx, r.label, q.split FROM ranked r JOIN q ON q.label = r.label AND r.rank >= q.lo AND r.rank < q.hi""")
def split_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes by weights that don't sum to 1 and that one class cannot meet."""
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("idx"), label.alias("label"))
    return sp.stratified_split(rows, SHARES, {0: 60, 1: 30, 2: 30}, seed=4).select("idx", "label", "split")


#: Rows of label 1 before each rank.
PRE = ", ranked AS (SELECT idx, label, row_number() OVER (ORDER BY ts, idx) AS rank FROM timed), pre AS (SELECT 0 AS rank, 0 AS pos UNION ALL SELECT rank, sum(label) OVER (ORDER BY rank) AS pos FROM ranked)"


@query(T + COUNTS + PRE + """, m AS (SELECT *, n - ca - cb AS cc, greatest(0, ca - 100) AS p_lo, greatest(0, ca - 100, ca + cb - 100) AS q_lo, least(n, ca + cb + 100) AS q_hi FROM c),
a AS (SELECT *, unnest(range(p_lo, least(n, ca + 100) + 1, 20)) AS p FROM m), b AS (SELECT *, unnest(range(greatest(p, q_lo), q_hi + 1, 20)) AS q FROM a),
gr AS (SELECT n, ca, cb, cc, p, q FROM b UNION SELECT n, ca, cb, cc, ca, ca + cb FROM m), h AS (SELECT *, q + least(cc, n - q) AS e FROM gr),
v AS (SELECT h.*, CAST(x.pos AS DOUBLE) / p AS r0, CAST(y.pos - x.pos AS DOUBLE) / (q - p) AS r1, CAST(z.pos - y.pos AS DOUBLE) / (e - q) AS r2 FROM h JOIN pre x ON x.rank = p JOIN pre y ON y.rank = q JOIN pre z ON z.rank = e),
s AS (SELECT *, round(2.0 * abs(r0 - r1) + 2.0 * abs(r0 - r2) + 2.0 * abs(r1 - r2) + 0.0001 * (abs(p - ca) + abs(q - p - cb) + abs(e - q - cc)), 9) AS score FROM v)
SELECT p, q, e AS "end", round(score, 6) AS score FROM s ORDER BY s.score, NOT (p = ca AND q = ca + cb), p, q LIMIT 1""")
def split_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of a temporal split that hold the splits' class shares nearest to each other."""
    ranked = rk.global_rank(tb.timed_samples(spark, sf_dir), "ts", "idx")
    best = sp.balanced_cuts(ranked, ranked.count(), SHARES, max_shift=100, step=20, penalty=0.0001)
    return best.select("p", "q", "end", F.round("score", 6).alias("score"))


TRIM = "(SELECT min(t) FROM (SELECT unnest(range(0, {length} + 1, 10)) AS t FROM m) k, m JOIN pre x ON x.rank = {lo} JOIN pre y ON y.rank = {hi} WHERE abs(CASE WHEN {lo} = {hi} THEN 0.5 ELSE CAST(y.pos - x.pos AS DOUBLE) / ({hi} - {lo}) END - 0.34) <= 0.004)"


@query(T + COUNTS + PRE + f""", m AS (SELECT *, ca + cb AS cq FROM c),
t AS (SELECT {TRIM.format(length="ca", lo="k.t", hi="m.ca")} AS t0, {TRIM.format(length="cb", lo="m.ca", hi="m.cq - k.t")} AS t1, {TRIM.format(length="(n - cq)", lo="m.cq", hi="m.n - k.t")} AS t2),
cut AS (SELECT CASE WHEN t0 IS NULL OR t1 IS NULL OR t2 IS NULL THEN [0, 0, 0] ELSE [t0, t1, t2] END AS t FROM t)
SELECT idx, CASE WHEN rank <= ca THEN 0 WHEN rank <= cq THEN 1 ELSE 2 END AS split FROM ranked, m, cut
WHERE (rank > cut.t[1] AND rank <= ca) OR (rank > ca AND rank <= cq - cut.t[2]) OR (rank > cq AND rank <= n - cut.t[3])""")
def split_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temporal split whose splits are trimmed to come near given class weights."""
    return _named(sp.balanced_split(tb.timed_samples(spark, sf_dir), SHARES, {0: 66, 1: 34}, step=10, tolerance=0.004))


@query(T + " SELECT idx, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed")
def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.global_rank(tb.timed_samples(spark, sf_dir), "ts", "idx").select("idx", "rank")


@query(T + " SELECT label, count(*) AS n FROM (SELECT label, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed) WHERE rank >= 100 AND rank < 1100 GROUP BY label")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.segment_counts(tb.timed_samples(spark, sf_dir), 100, 1100)


@query(T + ", r AS (SELECT label, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed), p AS (SELECT unnest([0, 10, 500, 1000]) AS edge) SELECT CAST(edge AS BIGINT) AS rank, count(r.rank) AS n, coalesce(sum(label), 0) AS pos FROM p LEFT JOIN r ON r.rank < edge GROUP BY edge")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.prefix_counts(rk.global_rank(tb.timed_samples(spark, sf_dir), "ts", "idx"), [0, 10, 500, 1000])


@query(T + " SELECT idx, ts, label FROM timed ORDER BY ts, idx LIMIT 50")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.timed_samples(spark, sf_dir).orderBy("ts", "idx").limit(50)


@query(T + " SELECT idx FROM timed ORDER BY md5('11:' || idx), idx LIMIT 64")
def check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.seeded_sample(tb.timed_samples(spark, sf_dir), "idx", 64, 11).select("idx")


@query(T + " SELECT idx, row_number() OVER (ORDER BY md5('5:' || idx // 512), md5('5:' || idx), idx) - 1 AS pos FROM timed")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.timed_samples(spark, sf_dir).withColumn("shard", F.floor(F.col("idx") / 512))
    return rk.global_rank(rows, rk.seeded(F.col("shard"), 5), rk.seeded(F.col("idx"), 5), F.col("idx"), into="pos").select("idx", "pos")


@query(T + COUNTS + ", ranked AS (SELECT idx, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed), s AS (SELECT idx, rank, CASE WHEN rank < ca THEN 0 WHEN rank < ca + cb THEN 1 ELSE 2 END AS split FROM ranked, c)," + """
o AS (SELECT split, idx, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS r FROM s), b AS (SELECT split, r // 1024 AS bucket, md5(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY r)) AS digest, count(*) AS n FROM o GROUP BY 1, 2)
SELECT split, md5(string_agg(digest, ',' ORDER BY bucket)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY split""")
def split_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each split's ids in order: one rank over all of them, less each split's first."""
    split = sp.temporal_split(tb.timed_samples(spark, sf_dir), SHARES).select("idx", "split")
    ranked = rk.global_rank(split, "split", "idx")
    first = ranked.groupBy("split").agg(F.min("rank").alias("first"))  # a row a split
    return st.ordered_fingerprint(ranked.join(F.broadcast(first), "split").withColumn("rank", F.col("rank") - F.col("first")), "idx", "split")


@query("WITH e AS (SELECT unnest(range(0, (SELECT max(doc_id) FROM labels) + 1)) AS idx) SELECT idx FROM e WHERE idx NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the greatest labelled one that have no label."""
    rows = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    top = rows.agg(F.max("idx")).first()[0]
    return spark.range(0, (-1 if top is None else top) + 1).select(F.col("id").alias("idx")).join(rows, "idx", "left_anti")


@query(T + " SELECT CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS outside, count(*) AS rows FROM timed")
def split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits share no row and have no row that is not in the input."""
    rows = tb.timed_samples(spark, sf_dir)
    split = sp.random_split(rows, SHARES, seed=7)
    parts = [split.where(F.col("split") == i).select("idx") for i in range(3)]
    shared = parts[0].intersect(parts[1]).union(parts[0].intersect(parts[2])).union(parts[1].intersect(parts[2]))
    outside = split.select("idx").subtract(rows.select("idx"))
    return shared.agg(F.count("*").alias("shared")).crossJoin(outside.agg(F.count("*").alias("outside"))).crossJoin(split.agg(F.count("*").alias("rows")))


@query(T + ", f AS (SELECT CAST(c_custkey AS BIGINT) AS idx, c_acctbal AS x FROM customer) SELECT t.idx, f.x FROM timed t JOIN f USING (idx)")
def aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = tb.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_acctbal").alias("x"))
    return sp.align(tb.timed_samples(spark, sf_dir).join(features.select("idx"), "idx", "left_semi"), features).select("idx", "x")


@query(T + ", x AS (SELECT count(*) AS n FROM timed) SELECT n, n - (n // 2 + n // 4) AS actual_removed, n - (n // 2 + n // 4) AS expected_removed, 'shares' AS reason FROM x")
def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.timed_samples(spark, sf_dir)
    n = rows.count()
    return sp.removed_report(n, sp.temporal_split(rows, (0.5, 0.25, 0.0)), (0.5, 0.25, 0.0), "shares")
