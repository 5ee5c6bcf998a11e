"""Queries of executables as tables: inert files put together from the parts table, byte by byte, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.operators import layout
from bytebasin.registry import query
from bytebasin.sources import tables as tb
from bytebasin.sources.shared import checkpointed

#: Where the headers lie and what follows them.
E, OPTIONAL, RAW = 0x80, 0xE0, 0x400
#: Flags of sections in turn.
FLAGS = (0x60000020, 0x40000040, 0xC0000040, 0x80000000)


def _le(x: Column | int, width: int) -> Column:
    """A number as little-endian hex digits."""
    x = (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(width)])


def _zeros(n: int) -> Column:
    return F.lit("00" * n)


def executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, data): for each part a file of one to three sections and a tail of ``p_size`` bytes.

    Section i has 64 * (i + 1) bytes. Every other file has an export directory in its first section, every fifth a CLR
    header there, whose first pair points to the second section: both of them are managed.
    """
    part = tb.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("k"))
    # two numbers a row make up whole files: dealt first, as the table is read by few tasks, a megabyte of it by one
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    k = F.col("k")
    n = k % 3 + 1
    tail_at = RAW + 32 * n * (n + 1)
    export, clr = F.when(k % 2 == 0, F.concat(_le(0x1010, 4), _le(16, 4))).otherwise(_zeros(8)), F.when(k % 5 == 0, F.concat(_le(0x1000, 4), _le(72, 4))).otherwise(_zeros(8))
    directories = F.concat(export, _zeros(24), _le(tail_at, 4), _le(k, 4), _zeros(72), clr, _zeros(8))
    sections, bodies = [], []
    for i in range(3):
        flags = F.get(F.array(*[F.lit(f) for f in FLAGS]), ((k + i) % 4).cast("int"))
        size, at = 64 * (i + 1), RAW + 32 * i * (i + 1)
        entry = F.concat(_zeros(8), _le(size, 4), _le(0x1000 * (i + 1), 4), _le(size, 4), _le(at, 4), _zeros(12), _le(flags, 4))
        sections.append(F.when(n > i, entry).otherwise(F.lit("")))
        body = _zeros(size) if i else F.concat(_zeros(8), F.when(k % 5 == 0, F.concat(_le(0x2000, 4), _le(16, 4))).otherwise(_zeros(8)), _zeros(48))
        bodies.append(F.when(n > i, body).otherwise(F.lit("")))
    head = F.concat(F.lit("4D5A"), _zeros(58), _le(E, 4), _zeros(64), F.lit("50450000"), _le(0x14C, 2), _le(n, 2), _le(F.col("name") * 1000, 4), _zeros(8), _le(OPTIONAL, 2), _zeros(2))
    optional = F.concat(_le(0x10B, 2), _zeros(58), _le(RAW, 4), _zeros(28), _le(16, 4), directories)
    headers = F.rpad(F.concat(head, optional, *sections), 2 * RAW, "0")
    blobs = part.select("name", F.unhex(F.concat(headers, *bodies, F.repeat(F.lit("AB"), k.cast("int")))).alias("data"))
    return checkpointed(blobs)  # else each field that is read would put the bytes together again


P = """WITH p AS (SELECT p_partkey AS name, CAST(p_size AS BIGINT) AS k, CAST(p_size % 3 + 1 AS BIGINT) AS n FROM part), f AS (SELECT *, 1024 + 32 * n * (n + 1) AS tail, 1024 + 32 * n * (n + 1) + k AS size FROM p),
s AS (SELECT name, i AS sec_no, k, n, size, 64 * (i + 1) AS bytes, 1024 + 32 * i * (i + 1) AS off, CAST([1610612768, 1073741888, 3221225536, 2147483648][(k + i) % 4 + 1] AS BIGINT) AS flags, k % 5 = 0 AND i < 2 AS managed FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
h AS (SELECT name, unnest(['HEADERS', 'DOS_HEADER', 'DOS_STUB', 'COFF_HEADER', 'OPTN_HEADER', 'SECTN_TABLE']) AS label, unnest([0, 0, 64, 132, 152, 376]) AS "start", unnest([1024, 64, 128, 152, 376, 376 + 40 * n]) AS "end" FROM f),
d AS (SELECT name, 0 AS dir, 'EXPORT' AS label, 1040 AS "start", 1056 AS "end" FROM f WHERE k % 2 = 0 UNION ALL SELECT name, 4, 'CERTIFICATE', tail, size FROM f UNION ALL SELECT name, 14, 'CLR', 1024, least(size, 1096) FROM f WHERE k % 5 = 0)"""


@query(P + " SELECT name, size, 128 AS e_lfanew, 332 AS machine, n AS n_sections, name * 1000 AS timestamp, 224 AS optional_size, 1024 AS headers_size FROM f")
def executable_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.headers(executables(spark, sf_dir)).drop("plus")


@query(P + " SELECT name, sec_no, 4096 * (sec_no + 1) AS vaddr, bytes AS vsize, off AS raw_off, bytes AS raw_size, flags FROM s")
def executable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sections(executables(spark, sf_dir)).drop("size", "managed")


@query(P + ' SELECT name, dir, label, "start", "end" FROM d')
def executable_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.directories(executables(spark, sf_dir))


@query(P + ' SELECT name, label, "start", "end" FROM h')
def executable_header_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.header_ranges(executables(spark, sf_dir))


@query(P + " SELECT name, sec_no FROM s WHERE managed")
def managed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.managed_sections(executables(spark, sf_dir))


CLASS = "CASE WHEN flags & 536870912 <> 0 THEN 'CODE' WHEN flags & 1073741824 <> 0 THEN 'DATA' END"
DNET = "CASE WHEN managed THEN 'DNET' ELSE '' END"


@query(P + f""", bits AS (SELECT unnest(['CNT_CODE', 'CNT_INITIALIZED_DATA', 'MEM_EXECUTE', 'MEM_READ', 'MEM_WRITE']) AS label, unnest([32, 64, 536870912, 1073741824, 2147483648]) AS bit),
levels AS (SELECT unnest(['COARSE', 'ROUGH', 'MIDDLE', 'FINE']) AS level), o AS (SELECT name, label, "start", "end" FROM h WHERE label = 'HEADERS'),
taken AS (SELECT name, "start", "end" FROM o UNION ALL SELECT name, off, off + bytes FROM s UNION ALL SELECT name, tail, size FROM f UNION ALL SELECT name, "start", "end" FROM d),
edges AS (SELECT name, "end" AS "from", lead("start") OVER (PARTITION BY name ORDER BY "start", "end") AS upto, max("end") OVER (PARTITION BY name ORDER BY "start", "end") AS reach FROM taken),
r AS (SELECT name, level, label, "start", "end" FROM o, levels WHERE level <> 'FINE' UNION ALL SELECT name, level, 'OVERLAY', tail, size FROM f, levels
UNION ALL SELECT name, level, 'OTHER', reach, upto FROM edges, levels WHERE upto > reach
UNION ALL SELECT name, 'COARSE', 'SECTION', off, off + bytes FROM s
UNION ALL SELECT name, 'ROUGH', CASE WHEN managed THEN 'DNETSEC' ELSE 'OTHRSEC' END, off, off + bytes FROM s
UNION ALL SELECT name, 'MIDDLE', {DNET} || {CLASS}, off, off + bytes FROM s WHERE {CLASS} IS NOT NULL
UNION ALL SELECT name, 'FINE', CASE WHEN flags & 2147483648 <> 0 THEN 'W' ELSE 'R' END || {DNET} || {CLASS}, off, off + bytes FROM s WHERE {CLASS} IS NOT NULL
UNION ALL SELECT name, 'FINE', label, "start", "end" FROM h WHERE label <> 'HEADERS' UNION ALL SELECT name, level, 'DIRECTORY', "start", "end" FROM d, levels WHERE level <> 'FINE'
UNION ALL SELECT name, 'FINE', CASE label WHEN 'EXPORT' THEN 'EDATA' WHEN 'CLR' THEN 'CLR' ELSE 'OTHERDIR' END, "start", "end" FROM d)
SELECT name, 'partitions' AS "group", level, label, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM r
UNION ALL SELECT name, 'characteristics', NULL, label, off, off + bytes FROM s, bits WHERE flags & bit <> 0""")
def executable_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.structures(executables(spark, sf_dir))
