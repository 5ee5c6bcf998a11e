"""Queries of bytes: entropy, distributions, windows, patches, bitmaps, scalar functions on blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.functions import scalars as sc
from bytebasin.operators import bitmaps as bm
from bytebasin.operators import signals as sg
from bytebasin.operators import stats as st
from bytebasin.registry import query
from bytebasin.sources import tables as tb

#: A row for each byte of the documents that the SQL can name one by one.
BYTES = """WITH hexed AS (SELECT doc_id AS name, regexp_extract_all(hex(encode(text)), '..') AS pairs, octet_length(encode(text)) AS size FROM documents),
bytes AS (SELECT name, size, pos, strpos('0123456789ABCDEF', left(pair, 1)) * 16 - 16 + strpos('0123456789ABCDEF', right(pair, 1)) - 1 AS byte
FROM (SELECT name, size, unnest(pairs) AS pair, unnest(range(0, size)) AS pos FROM hexed))"""
ENTROPY = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"


@query(BYTES + f""", h AS (SELECT name, byte, CAST(count(*) AS DOUBLE) AS c FROM bytes GROUP BY 1, 2), e AS (SELECT name, {ENTROPY} AS entropy FROM h GROUP BY name)
SELECT toxic AS label, count(*) AS n, round(avg(entropy), 6) AS avg_entropy FROM e LEFT JOIN labels ON doc_id = name GROUP BY toxic""")
def entropy_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: mean byte entropy of documents by label."""
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"))
    labels = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("toxic").alias("label"))
    found = st.entropy(docs).join(labels, "name", "left")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("entropy"), 6).alias("avg_entropy"))


@query(BYTES + " SELECT name, byte, count(*) AS n FROM bytes GROUP BY 1, 2")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(tb.samples(spark, sf_dir)).withColumn("byte", F.col("byte").cast("long"))


@query(BYTES + " SELECT byte, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS p FROM bytes GROUP BY byte")
def byte_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.byte_distribution(tb.samples(spark, sf_dir))
    return out.select(F.col("byte").cast("long").alias("byte"), "n", F.round("p", 9).alias("p"))


@query(BYTES + f""", w AS (SELECT name, size, byte, unnest(range(greatest(0, CAST(ceil((pos - 64) / 64.0) AS BIGINT)), least(CAST(ceil((size - 64) / 64.0) AS BIGINT) - 1, pos // 64) + 1)) AS k FROM bytes WHERE size > 65),
h AS (SELECT name, size, k, byte, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY 1, 2, 3, 4)
SELECT name, k, k * 64 + 32 AS "start", least(k * 64 + 96, size) AS "end", round({ENTROPY}, 6) AS entropy FROM h GROUP BY name, size, k""")
def sliding_entropy_s64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.window_entropy(tb.samples(spark, sf_dir), 32, 64).withColumn("entropy", F.round("entropy", 6))


@query(BYTES + f""", w AS (SELECT name, size, byte, unnest(range(greatest(0, CAST(ceil((pos - 512) / 256.0) AS BIGINT)), least(CAST(ceil((size - 512) / 256.0) AS BIGINT) - 1, pos // 256) + 1)) AS k FROM bytes WHERE size > 513),
h AS (SELECT name, size, k, byte, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY 1, 2, 3, 4), e AS (SELECT name, k, {ENTROPY} AS e FROM h GROUP BY name, k)
SELECT name, count(*) AS windows, count(*) FILTER (WHERE e > 4.2) AS high FROM e GROUP BY name""")
def entropy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sg.window_entropy(tb.samples(spark, sf_dir), 256, 256)
    return found.groupBy("name").agg(F.count("*").alias("windows"), F.count_if(sg.high_entropy(F.col("entropy"), 4.2)).alias("high"))


@query(BYTES + " SELECT name, pos // 512 AS patch, max(byte) AS value, arg_max(pos, byte * 1000000 - pos) AS pos FROM bytes GROUP BY 1, 2")
def patch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.byte_patch_maxima(tb.samples(spark, sf_dir), 512)


@query(BYTES + " SELECT name, max(byte) AS value, arg_max(pos, byte * 1000000 - pos) AS pos FROM bytes GROUP BY 1")
def sequence_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.byte_patch_maxima(tb.samples(spark, sf_dir)).drop("patch")


@query(BYTES + f""", w AS (SELECT name, size, byte, unnest(range(greatest(0, pos - 8), least(size - 9, pos) + 1)) AS k FROM bytes WHERE size > 9), h AS (SELECT name, k, byte, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY 1, 2, 3), e AS (SELECT name, k, {ENTROPY} AS e FROM h GROUP BY name, k)
SELECT name, count(*) AS windows, round(avg(e), 6) AS mean, round(max(e), 6) AS most FROM e GROUP BY name""")
def rolling_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every window of 9 bytes."""
    found = sg.rolling_entropy(tb.samples(spark, sf_dir), 4)
    return found.groupBy("name").agg(F.count("*").alias("windows"), F.round(F.avg("entropy"), 6).alias("mean"), F.round(F.max("entropy"), 6).alias("most"))


@query("""WITH s AS (SELECT doc_id AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents), p AS (SELECT *, unnest(range(0, CAST(ceil(size / 512.0) AS BIGINT))) AS patch, CAST(ceil(size / 512.0) AS BIGINT) AS n_patches FROM s)
SELECT name, patch, n_patches, round((patch + 0.5::DOUBLE) / n_patches, 9) AS rel, round(greatest(0.0, least(1.0, (patch + 0.5::DOUBLE) / n_patches * size / 20000)), 9) AS abs FROM p""")
def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tb.samples(spark, sf_dir).select("name", "size")
    _, count = sc.patch_size(F.col("size"), size=512)
    rows = sizes.withColumn("n_patches", count.cast("long")).withColumn("patch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_patches") - 1)))
    out = sg.patch_centres(rows.where("size > 0"), 20000)
    return out.select("name", "patch", "n_patches", F.round("rel", 9).alias("rel"), F.round("abs", 9).alias("abs"))


@query("""SELECT doc_id AS name, sha256(encode(text)) AS sha, starts_with(text, 'Th') OR starts_with(text, 'El') AS magic, sha256(encode(left(text, 100))) AS prefix_sha, least(length(text), 100) AS kept,
CAST(ceil(octet_length(encode(text)) / 4096.0) * 4096 AS BIGINT) AS padded FROM documents""")
def blob_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text", F.encode("text", "UTF-8").alias("data"))
    return docs.select(
        "name", F.sha2("data", 256).alias("sha"), sc.starts_with_magic(F.col("data"), (b"Th", b"El")).alias("magic"), F.sha2(F.substring("text", 1, 100), 256).alias("prefix_sha"),
        F.least(F.length("text"), F.lit(100)).cast("long").alias("kept"), sc.round_up(F.length("data"), 4096).alias("padded"),
    )


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/b/' || sha256(encode(text)) || '.exe.bin' WHEN doc_id % 3 = 1 THEN sha256(encode(text)) ELSE 'x' || sha256(encode(text)) END AS path, sha256(encode(text)) AS sha FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha END AS name FROM n""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a/b/"), sha, F.lit(".exe.bin"))).when(F.col("doc_id") % 3 == 1, sha).otherwise(F.concat(F.lit("x"), sha))
    return tb.read(spark, sf_dir, "documents").select("doc_id", sc.clean_name(path).alias("name"))


@query(f"WITH {tb.TIMED_SQL} SELECT idx, CASE WHEN ts BETWEEN 0 AND 800000000 THEN ts ELSE -1 END AS ts, CASE WHEN ts BETWEEN 0 AND 800000000 THEN 'kept' ELSE 'no time' END AS reason FROM timed")
def clean_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.timed_samples(spark, sf_dir).withColumn("ts", sc.clean_timestamp(F.col("ts"), 800_000_000))
    return rows.select("idx", "ts", F.when(F.col("ts") < 0, "no time").otherwise("kept").alias("reason"))


@query("""SELECT doc_id AS name, CAST(coalesce(toxic, -1) = 1 AS BOOLEAN) AS malware, CASE WHEN source = 'src1' THEN '' ELSE source END AS family, length(text) > 200 AND NOT ends_with(source, '3') AS usable
FROM documents LEFT JOIN labels USING (doc_id)""")
def null_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.read(spark, sf_dir, "documents").join(tb.read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    family = F.coalesce(F.nullif("source", F.lit("src1")), F.lit(""))
    return docs.select(F.col("doc_id").alias("name"), (F.coalesce("toxic", F.lit(-1)) == 1).alias("malware"), family.alias("family"), ((F.length("text") > 200) & ~F.col("source").endswith("3")).alias("usable"))


@query("SELECT p_size & 63 AS mask, count(*) AS n FROM part GROUP BY 1")
def pack_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tb.read(spark, sf_dir, "part")
    mask = bm.mask_of([F.getbit(F.col("p_size").cast("long"), F.lit(k)) == 1 for k in range(6)])
    return part.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))


@query("SELECT k AS bit, count(*) AS n FROM part, range(0, 6) r(k) WHERE (p_size >> CAST(k AS INTEGER)) & 1 = 1 GROUP BY k")
def explode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tb.read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("mask"))
    return bm.explode_mask(part, "mask", 6).groupBy(F.col("bit").cast("long").alias("bit")).agg(F.count("*").alias("n"))


FLAGS = "WITH f AS (SELECT p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_size % 2 = 1 AS value FROM part)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = tb.read(spark, sf_dir, "part")
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return part.select(F.col("p_brand").alias("name"), pos.cast("long").alias("pos"), (F.col("p_size") % 2 == 1).alias("value"))


@query(FLAGS + " SELECT name, pos // 8 AS byte, sum(CASE WHEN value THEN 1 << CAST(pos % 8 AS INTEGER) ELSE 0 END) AS bits FROM f GROUP BY 1, 2")
def bitmap_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.pack(_flags(spark, sf_dir), ["name"])


@query(FLAGS + " SELECT name, pos, value FROM f")
def bitmap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    counts = flags.groupBy("name").agg(F.count("*").alias("count"))
    return bm.unpack(bm.pack(flags, ["name"]).join(counts, "name"), "count").select("name", "pos", "value")


@query(FLAGS + """, s AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS pos, value FROM f WHERE pos % 3 = 0 OR pos BETWEEN 5 AND 9)
SELECT name, pos // 8 AS byte, sum(CASE WHEN value THEN 1 << CAST(pos % 8 AS INTEGER) ELSE 0 END) AS bits FROM s GROUP BY 1, 2""")
def bitmap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    return bm.select(bm.pack(flags, ["name"]), flags.where("pos % 3 = 0 OR pos BETWEEN 5 AND 9"), ["name"])


@query(FLAGS + """, n AS (SELECT name, 8 * CAST(ceil(count(*) / 8.0) AS BIGINT) AS top FROM f GROUP BY name), k AS (SELECT n.name, p_size AS "start", least(p_size + 1 + p_partkey % 90, top) AS "end", p_partkey FROM part JOIN n ON n.name = p_brand),
s AS (SELECT k.name, row_number() OVER (PARTITION BY k.name ORDER BY "start", "end", p_partkey, pos) - 1 AS pos, coalesce(value, false) AS value FROM (SELECT name, "start", "end", p_partkey, unnest(range("start", "end")) AS pos FROM k) k LEFT JOIN f USING (name, pos))
SELECT name, pos // 8 AS byte, sum(CASE WHEN value THEN 1 << CAST(pos % 8 AS INTEGER) ELSE 0 END) AS bits FROM s GROUP BY 1, 2""")
def bitmap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each brand's bitmap for every part of it, one after another; they overlap and go beyond the end."""
    ranges = tb.read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 1 + F.col("p_partkey") % 90).cast("long").alias("end"))
    return bm.select_ranges(bm.pack(_flags(spark, sf_dir), ["name"]), ranges, ["name"])


@query(FLAGS + " SELECT name, pos // 8 AS byte, sum(CASE WHEN value THEN 1 << CAST(pos % 8 AS INTEGER) ELSE 0 END) AS bits FROM f WHERE pos < 24 GROUP BY 1, 2")
def bitmap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.trim(bm.pack(_flags(spark, sf_dir), ["name"]), 20)
