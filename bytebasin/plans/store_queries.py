"""Queries of packed data sets and their checks, on documents as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.operators import integrity as ig
from bytebasin.operators import ranking as rk
from bytebasin.operators import stats as st
from bytebasin.plans.blob_queries import BYTES
from bytebasin.registry import query
from bytebasin.sources import store
from bytebasin.sources import tables as tb

D = """WITH docs AS (SELECT doc_id AS name, encode(text) AS data, toxic AS label, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents LEFT JOIN labels USING (doc_id)),
packed AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS idx, (row_number() OVER (ORDER BY name) - 1) // 64 AS shard FROM docs)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, size, idx, shard): blobs themselves are not ranked."""
    return rk.shards_by_count(tb.samples(spark, sf_dir).select("name", "label", "size"), 64, "name")


@query(D + " SELECT name, idx, shard FROM packed")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("name", "idx", "shard")


@query(D + " SELECT shard, count(*) AS n, max(size) AS max_size, min(size) AS min_size, round(avg(size), 6) AS avg_size, round(avg(label), 6) AS positive FROM packed GROUP BY shard")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.shard_statistics(packed(spark, sf_dir))
    return out.withColumns({"avg_size": F.round("avg_size", 6), "positive": F.round("positive", 6)})


@query(D + " SELECT idx, shard FROM packed")
def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(spark, sf_dir)
    return store.shard_of(rows.select("idx"), rows)


@query(D + " SELECT name, idx, size FROM packed WHERE shard IN (0, 2)")
def shard_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).where(F.col("shard").isin(0, 2)).select("name", "idx", "size")


@query(D + ", c AS (SELECT shard, count(*) AS n FROM packed GROUP BY shard), r AS (SELECT shard, sum(n) OVER (ORDER BY shard) AS upto FROM c) SELECT min(shard) AS last_shard FROM r WHERE upto >= 100")
def shard_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(rk.shard_prefix(packed(spark, sf_dir), 100),)], "last_shard long")


@query(D + ", s AS (SELECT DISTINCT shard FROM packed) SELECT shard, shard % 3 AS turn, ntile(3) OVER (ORDER BY shard) - 1 AS chunk FROM s")
def worker_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = packed(spark, sf_dir).select("shard").distinct()
    return rk.chunk_of(shards, 3).select("shard", rk.worker_of(F.col("shard"), 3).alias("turn"), F.col("worker").cast("long").alias("chunk"))


@query(D + " SELECT CAST(sum(size) AS BIGINT) AS total, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS avg_size, median(size) AS median_size FROM docs")
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.size_summary(tb.samples(spark, sf_dir)).withColumn("avg_size", F.round("avg_size", 6))


@query(D + " SELECT label, count(*) AS n FROM docs GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.samples(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT sha256(encode(text)) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.duplicates(tb.samples(spark, sf_dir).select(F.sha2("data", 256).alias("sha")), "sha")


@query("""WITH d AS (SELECT doc_id AS idx, sha256(encode(text)) AS name, doc_id // 64 AS shard FROM documents), s AS (SELECT d.* FROM d JOIN labels ON doc_id = idx),
m AS (SELECT idx, CASE WHEN quality = 0 THEN 'other' ELSE name END AS name, shard + coalesce(toxic, 0) AS shard FROM d LEFT JOIN labels ON doc_id = idx),
b AS (SELECT coalesce(s.idx, m.idx) AS idx, CASE WHEN s.idx IS NULL THEN 'no size row' WHEN m.idx IS NULL THEN 'no meta row' WHEN s.name <> m.name THEN 'names differ' WHEN s.shard <> m.shard THEN 'shards differ' END AS "check" FROM s FULL JOIN m ON s.idx = m.idx)
SELECT "check", CAST(idx AS VARCHAR) AS key FROM b WHERE "check" IS NOT NULL UNION ALL SELECT 'repeated name', name FROM s GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'missing idx', CAST(i AS VARCHAR) FROM range(0, (SELECT max(idx) + 1 FROM s)) r(i) WHERE i NOT IN (SELECT idx FROM s)""")
def dataset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the labelled documents against a table of all, in which labels stand for what was entered wrong."""
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.sha2("text", 256).alias("name"), F.floor(F.col("doc_id") / 64).alias("shard"))
    labels = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality", "toxic")
    meta = docs.join(labels, "idx", "left").select("idx", F.when(F.col("quality") == 0, "other").otherwise(F.col("name")).alias("name"), (F.col("shard") + F.coalesce("toxic", F.lit(0))).alias("shard"))
    return ig.check_dataset(docs.join(labels.select("idx"), "idx", "left_semi"), meta)


@query("""WITH d AS (SELECT doc_id // 64 AS shard, octet_length(encode(text)) AS size, quality, toxic, l.doc_id IS NOT NULL AS here, lang <> 'fr' AS wanted FROM (SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) d LEFT JOIN labels l USING (doc_id))
SELECT shard, count(*) FILTER (WHERE here) AS samples, count(*) FILTER (WHERE wanted AND NOT here) AS missing, count(*) FILTER (WHERE here AND NOT wanted) AS unexpected, count(*) FILTER (WHERE here AND wanted AND toxic = 1) AS wrong_label,
count(*) FILTER (WHERE here AND size > 3000) AS oversized, count(*) FILTER (WHERE here AND quality = 0 AND size < 2999) AS wrong_digest, count(*) FILTER (WHERE NOT wanted) AS stray_regions FROM d GROUP BY shard HAVING bool_or(here OR wanted)""")
def sha_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blobs are those of labelled documents; toxic ones have a wrong label and poor ones a changed byte. French
    ones, and regions of French ones, nobody expects."""
    docs = tb.read(spark, sf_dir, "documents").groupBy("text").agg(F.min(F.struct("doc_id", "lang")).alias("d")).select("text", "d.*")
    rows = docs.select(F.floor(F.col("doc_id") / 64).alias("shard"), "doc_id", "lang", F.sha2("text", 256).alias("name"), F.encode("text", "UTF-8").alias("data"))
    expected = rows.where("lang <> 'fr'").select("shard", "name", F.lit(1).alias("label"))
    # a changed blob is one byte longer
    changed = F.when((F.col("quality") == 0) & (F.length("data") < 2999), F.concat(F.col("data"), F.lit(b"!"))).otherwise(F.col("data"))
    labelled = rows.join(tb.read(spark, sf_dir, "labels"), "doc_id")
    stored = labelled.select("shard", "name", changed.alias("data"), (F.col("toxic") != 1).cast("int").alias("label"))
    return ig.verify_shards(stored, expected, rows.select("shard", "name"), 3000)


@query("""WITH k AS (SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 200), s AS (SELECT doc_id, encode(text) AS data, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT (SELECT count(*) FROM s) AS rows, (SELECT CAST(max(octet_length(data)) AS BIGINT) FROM s) AS max_size, count(*) AS checked, count(*) FILTER (WHERE quality = 0) AS differing FROM k JOIN s USING (doc_id)""")
def validated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of stored blobs against their sources; those of poor documents were stored with a changed first byte."""
    docs = tb.samples(spark, sf_dir).select("name", "data")
    poor = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 0).alias("poor"))
    first = F.when(F.substring("data", 1, 1) == F.lit(b"#"), F.lit(b"!")).otherwise(F.lit(b"#"))
    rest = F.expr("substring(data, 2, length(data))")
    stored = docs.join(poor, "name", "left").select("name", F.when(F.col("poor") & (F.length("data") > 0), F.concat(first, rest)).otherwise(F.col("data")).alias("data"))
    return ig.validate_sample(stored, docs, 2**31 - 1, 200)


@query("SELECT doc_id AS name, left(sha256(encode(text)), 1) || '/' || substr(sha256(encode(text)), 2, 1) || '/' || sha256(encode(text)) AS path, sha256(encode(text)) || ' ' || coalesce(toxic, 0) AS line FROM documents LEFT JOIN labels USING (doc_id)")
def fan_out_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.samples(spark, sf_dir).withColumn("sha", F.sha2("data", 256))
    return rows.select("name", store.fan_out(F.col("sha")).alias("path"), F.concat_ws(" ", "sha", F.coalesce("label", F.lit(0)).cast("string")).alias("line"))


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE lang = 'en' UNION ALL SELECT source FROM documents WHERE lang = 'de') GROUP BY source")
def chained_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.read(spark, sf_dir, "documents")
    return store.concat(docs.where("lang = 'en'"), docs.where("lang = 'de'")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {tb.TIMED_SQL}, s AS (SELECT o_orderkey AS idx, o_custkey AS name FROM orders) SELECT c.c_custkey AS name, coalesce(min(t.ts), -1) AS ts FROM customer c LEFT JOIN s ON s.name = c.c_custkey LEFT JOIN timed t ON t.idx = s.idx GROUP BY 1")
def timestamp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First time by name, -1 where there is none."""
    orders = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("idx"), F.col("o_custkey").alias("name"))
    times = orders.join(tb.timed_samples(spark, sf_dir), "idx").groupBy("name").agg(F.min("ts").alias("ts"))
    names = tb.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    return names.join(times, "name", "left").select("name", F.coalesce("ts", F.lit(-1).cast("long")).alias("ts"))


@query(f"""{BYTES}, h AS (SELECT name, byte, count(*) AS c, max(size) AS size FROM bytes GROUP BY 1, 2), s AS (SELECT name, sum(c * ((byte * 7) % 13 - 6)) AS a, sum(c * ((byte * 5) % 11 - 5)) AS b, max(size) AS size FROM h GROUP BY name)
SELECT d.doc_id AS name, coalesce(toxic, 0) AS label, round(coalesce(a / CAST(size AS DOUBLE), 0), 6) AS a, round(coalesce(b / CAST(size AS DOUBLE), 0), 6) AS b FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN s ON s.name = d.doc_id""")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear scorer of the user's over the shares of byte values in a blob."""
    import numpy as np

    values = np.arange(256)
    weights = np.stack([values * 7 % 13 - 6, values * 5 % 11 - 5], axis=1).astype(float)

    def model(blobs: list[bytes]) -> np.ndarray:
        counts = np.stack([np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in blobs])
        return counts @ weights / np.maximum(1, counts.sum(axis=1, keepdims=True))

    samples = tb.samples(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit(0)))
    scored = store.score_blobs(samples, model)
    return scored.select("name", "label", F.round(F.col("logits")[0], 6).alias("a"), F.round(F.col("logits")[1], 6).alias("b"))


@query("""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, CAST(ceil(octet_length(encode(text)) / 4096.0) * 4096 AS BIGINT) AS p FROM documents),
w AS (SELECT idx, p AS held, 0 AS shard FROM n WHERE idx = 0 UNION ALL SELECT n.idx, CASE WHEN held + p > 65536 THEN p ELSE held + p END, CASE WHEN held + p > 65536 THEN shard + 1 ELSE shard END FROM w JOIN n ON n.idx = w.idx + 1)
SELECT idx, CAST(shard AS BIGINT) AS shard FROM w""")
def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next fit by bytes over all documents in order."""
    return rk.shards_by_bytes(packed(spark, sf_dir).drop("shard"), 65536).select("idx", "shard")


@query("""SELECT p_partkey AS name, CASE WHEN p_size & 32 <> 0 THEN 'CODE' WHEN p_size & 16 <> 0 THEN 'DATA' ELSE 'OTHER' END AS class, (p_size & 8) <> 0 AS writable FROM part""")
def section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section classes, three bits of a size standing for the flags to execute, read and write."""
    from bytebasin.operators import layout

    size = F.col("p_size").cast("long")
    bits = {32: layout.EXECUTE, 16: layout.READ, 8: layout.WRITE}
    flags = F.lit(0).cast("long")
    for bit, flag in bits.items():
        flags = flags + F.when(size.bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(flag).cast("long")).otherwise(F.lit(0).cast("long"))
    parts = tb.read(spark, sf_dir, "part").withColumn("flags", flags)
    return parts.select(F.col("p_partkey").alias("name"), layout.section_class(F.col("flags")).alias("class"), (F.col("flags") >= layout.WRITE).alias("writable"))


@query("""SELECT p_partkey AS name, label, CAST(p_size AS BIGINT) AS "start", CAST(p_size + 10 AS BIGINT) AS "end" FROM part, (SELECT unnest(['MEM_EXECUTE', 'MEM_READ', 'MEM_WRITE']) AS label, unnest([1, 2, 4]) AS bit) WHERE p_size & bit <> 0""")
def flagged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every flag that a section carries."""
    from bytebasin.operators import layout

    parts = tb.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("flags"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 10).cast("long").alias("end"))
    return layout.flag_ranges(parts, {"MEM_EXECUTE": 1, "MEM_READ": 2, "MEM_WRITE": 4})
