"""Queries of batches and token columns, on documents as sequences of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bytebasin.functions.scalars import pad_length
from bytebasin.operators import batching as bt
from bytebasin.operators import intervals as iv
from bytebasin.plans.blob_queries import BYTES
from bytebasin.registry import query
from bytebasin.sources import tables as tb

B = """WITH docs AS (SELECT doc_id AS name, octet_length(encode(text)) AS n FROM documents), b AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS rank FROM docs),
batched AS (SELECT *, rank // 8 AS batch, rank % 8 AS slot FROM b)"""
#: Tokens of each document in order, comma-joined, and their sum.
TOKENS = BYTES.replace("WITH", ",", 1) + ", said AS (SELECT name, string_agg(CAST(byte + 1 AS VARCHAR), ',' ORDER BY pos) AS tokens, CAST(sum(byte + 1) AS BIGINT) AS total, count(*) AS n FROM bytes GROUP BY name)"


#: Tokens of a text in SQL, comma-joined; and padded to a length.
SAID = "array_to_string(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda p: CAST(strpos('0123456789ABCDEF', left(p, 1)) * 16 + strpos('0123456789ABCDEF', right(p, 1)) - 16 AS VARCHAR)), ',')"
PADDED = "CASE WHEN n = 0 THEN substr(repeat(',0', length), 2) ELSE said || repeat(',0', length - n) END"
#: Lines of documents that aren't empty, their labels turning by three.
LINES = "lines AS (SELECT name, p - 1 AS ord, (p - 1) % 3 AS label, parts[p] AS line FROM (SELECT doc_id AS name, string_split(text, chr(10)) AS parts FROM documents) d, range(1, 100000) r(p) WHERE p <= len(parts) AND parts[p] <> '')"


#: Tokens that are written out as numbers at once.
SAID_AT_ONCE = 1 << 16


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("total", LongType()), StructField("digest", StringType())]))
def _told(rows: pa.Array) -> pa.Array:
    """Number, sum and digest of the tokens of a row's sequences, written as decimal numbers: one row at a time becomes
    Python objects, and of it one part at a time numbers."""
    ns, totals, digests = [], [], []
    for row in rows:
        x, digest = np.frombuffer(b"".join(row.as_py()), "<u2"), hashlib.md5()
        for lo in range(0, len(x), SAID_AT_ONCE):
            digest.update(("," * (lo > 0) + ",".join(map(str, x[lo : lo + SAID_AT_ONCE].tolist()))).encode())
        ns.append(len(x))
        totals.append(int(x.sum()))
        digests.append(digest.hexdigest())
    return pa.StructArray.from_arrays([pa.array(ns, pa.int64()), pa.array(totals, pa.int64()), pa.array(digests, pa.string())], ["n", "total", "digest"])


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"))
    return docs.select("name", bt.tokens_of("data").alias("tokens"))


@query(B + " SELECT name, batch, slot FROM batched WHERE batch < (SELECT count(*) // 8 FROM b)")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    return bt.batches(docs, 8, "name", drop_last=True)


@query("""WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch, octet_length(encode(text)) AS n FROM documents), m AS (SELECT batch, max(n) AS most FROM b GROUP BY batch)
SELECT batch, CAST(ceil(greatest(most, 100) / 64.0) * 64 AS BIGINT) AS multiple, CASE WHEN most <= 1024 THEN 1024 WHEN most <= 8192 THEN 8192 WHEN most <= 65536 THEN 65536 ELSE 1048576 END AS bin FROM m""")
def pad_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.batches(tb.samples(spark, sf_dir).select("name", "size"), 8, "name").groupBy("batch").agg(F.max("size").alias("most"))
    return rows.select("batch", pad_length(F.col("most"), 100, 64).alias("multiple"), pad_length(F.col("most"), bins=(1024, 8192, 65536, 1048576)).alias("bin"))


@query(B + TOKENS + """, l AS (SELECT batch, CAST(ceil(greatest(max(n), 16) / 8.0) * 8 AS BIGINT) AS length FROM batched GROUP BY batch),
r AS (SELECT batch, slot, length, CASE WHEN batched.n = 0 THEN substr(repeat(',0', length), 2) ELSE tokens || repeat(',0', length - batched.n) END AS padded FROM batched JOIN l USING (batch) LEFT JOIN said USING (name))
SELECT batch, length, count(*) AS n, md5(string_agg(padded, ',' ORDER BY slot)) AS digest FROM r GROUP BY batch, length""")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bt.batches(tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), 8, "name")
    out = bt.collate(_tokens(spark, sf_dir).join(names, "name"), least=16, multiple=8)
    return out.select("batch", "length", F.size("names").cast("long").alias("n"), _told("tokens")["digest"].alias("digest"))


@query(B + TOKENS + " SELECT name, n, total, md5(tokens) AS digest FROM said")
def token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).where(F.octet_length("tokens") > 0)
    return rows.select("name", _told(F.array("tokens")).alias("told")).select("name", "told.*")


@query(f"""WITH {LINES}, s AS (SELECT name, label, string_agg(line, '' ORDER BY ord) AS t FROM lines GROUP BY name, label),
k AS (SELECT DISTINCT doc_id AS name, l AS label FROM documents, range(0, 3) r(l)),
f AS (SELECT name, label, name // 8 AS batch, {SAID.format("coalesce(t, '')")} AS said, octet_length(encode(coalesce(t, ''))) AS n FROM k LEFT JOIN s USING (name, label)),
w AS (SELECT *, CAST(ceil(greatest(max(n) OVER (PARTITION BY batch, label), 16) / 64.0) * 64 AS BIGINT) AS length FROM f)
SELECT batch, label, count(*) AS rows, length, md5(string_agg({PADDED}, ',' ORDER BY name)) AS digest FROM w GROUP BY batch, label, length""")
def hierarchical_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each structure's bytes of every document as a sequence, padded by batch and structure."""
    sliced = iv.slice_blobs(tb.samples(spark, sf_dir), tb.line_regions(spark, sf_dir))
    names = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")).crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "label")))
    rows = names.join(sliced, ["name", "label"], "left").select(F.floor(F.col("name") / 8).alias("batch"), "label", F.col("name").alias("slot"), "name", bt.tokens_of("data").alias("tokens"))
    out = bt.collate(rows, least=16, multiple=64, keys=("batch", "label"))
    return out.select("batch", "label", F.size("names").cast("long").alias("rows"), "length", _told("tokens")["digest"].alias("digest"))


@query(f"""WITH {LINES}, r AS (SELECT name // 2 AS batch, label, name, ord, {SAID.format("line")} AS said, octet_length(encode(line)) AS n FROM lines),
k AS (SELECT DISTINCT doc_id // 2 AS batch, l AS label FROM documents, range(0, 3) x(l)),
f AS (SELECT batch, label, name, ord, coalesce(said, '0') AS said, coalesce(n, 1) AS n FROM k LEFT JOIN r USING (batch, label)),
w AS (SELECT *, CAST(ceil(greatest(max(n) OVER (PARTITION BY batch, label), 16) / 64.0) * 64 AS BIGINT) AS length FROM f)
SELECT batch, label, count(*) AS rows, length, md5(string_agg({PADDED}, ',' ORDER BY name, ord)) AS digest FROM w GROUP BY batch, label, length""")
def structural_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every region; a structure without any in a batch gets one row of a single padding value."""
    regions = tb.line_regions(spark, sf_dir)
    ordered = iv.region_order(regions, F.floor(F.col("name") / 2))
    pieces = iv.cut_pieces(tb.samples(spark, sf_dir), ordered, "batch", "label", F.col("local").alias("slot"))
    rows = pieces.select("batch", "label", "slot", "name", bt.tokens_of("piece").alias("tokens"))
    keys = tb.read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("batch")).distinct().crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "label")))
    out = bt.collate(bt.with_empty_structures(rows, keys), least=16, multiple=64, keys=("batch", "label"))
    return out.select("batch", "label", F.size("names").cast("long").alias("rows"), "length", _told("tokens")["digest"].alias("digest"))


@query("""WITH RECURSIVE rows AS (SELECT CASE l_linenumber WHEN 1 THEN 9 WHEN 2 THEN 9 WHEN 3 THEN 9 ELSE l_linenumber END AS token, l_orderkey AS pos, l_suppkey AS row FROM lineitem),
f AS (SELECT token, count(*) AS n FROM rows GROUP BY token), s AS (SELECT sum(n) AS total, 40 - count(*) AS budget FROM f),
p AS (SELECT token, CAST(n AS DOUBLE) / total * budget AS share FROM f, s), l AS (SELECT token, share, CASE WHEN share <= 1 THEN 1 ELSE CAST(2 ** floor(log2(share)) AS BIGINT) END AS low FROM p),
a0 AS (SELECT list(CASE WHEN share <= 1 OR share - low < 2 * low - share THEN low ELSE 2 * low END ORDER BY token) AS a, list(token ORDER BY token) AS t FROM l),
walk AS (SELECT 0 AS i, a, t FROM a0 UNION ALL SELECT i + 1, list_transform(a, lambda x, j: CASE WHEN (j - 1) = i % len(a) AND x > 1 THEN x // 2 ELSE x END), t FROM walk, s WHERE list_sum(a) > budget),
done AS (SELECT a, t FROM walk ORDER BY i DESC LIMIT 1), k AS (SELECT unnest(t) AS token, unnest(a) AS copies FROM done),
b AS (SELECT token, copies, (SELECT max(token) + 1 FROM k) + coalesce(sum(copies) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k WHERE copies > 1)
SELECT CAST(token AS BIGINT) AS token, CAST(CASE WHEN base IS NULL THEN token ELSE base + ((pos + row * 7) & (copies - 1)) END AS BIGINT) AS salted, count(*) AS n FROM rows LEFT JOIN b USING (token) GROUP BY 1, 2""")
def salted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salts for a key that many rows have, among a few that fewer have: the table's line numbers, three of them as one."""
    line = F.col("l_linenumber")
    rows = tb.read(spark, sf_dir, "lineitem").select(F.when(line <= 3, 9).otherwise(line).cast("long").alias("token"), F.col("l_orderkey").cast("long").alias("pos"), F.col("l_suppkey").cast("long").alias("row"))
    # the keys are line numbers, a handful
    counts = {r["token"]: float(r["n"]) for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return bt.salted(rows, bt.salt_plan(counts, 40), 7).groupBy("token", "salted").agg(F.count("*").alias("n"))
