"""Queries of the range operators on line items as ranges and documents as blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytebasin.operators import intervals as iv
from bytebasin.registry import query
from bytebasin.sources import tables as tb

R = f"WITH {tb.REGIONS_SQL}"
BIT = "CASE label WHEN 'CODE' THEN 1 WHEN 'DATA' THEN 2 WHEN 'DNETCODE' THEN 4 ELSE 8 END"
MERGED = R + """, flagged AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY name ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {source}),
islands AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
merged AS (SELECT name, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY name, island)"""
CLIPPED = 'SELECT name, "start", least("end", size) AS "end", size FROM regions WHERE least("end", size) > "start"'


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("name").agg(F.max("size").alias("size"))


@query(R + """SELECT name, label, greatest(0, "start") AS "start", least("end", size) AS "end" FROM regions WHERE least("end", size) > greatest(0, "start")""")
def clip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.clip(tb.regions(spark, sf_dir)).select("name", "label", "start", "end")


@query(R + """SELECT name, label, "start", least("end", 100) AS "end" FROM regions WHERE "start" < 100""")
def trim_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.trim(tb.regions(spark, sf_dir), 100).select("name", "label", "start", "end")


@query(R + """SELECT name, label, "start", least("end", "start" + 20) AS "end" FROM regions""")
def cap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.cap_lengths(tb.regions(spark, sf_dir), 20).select("name", "label", "start", "end")


@query(MERGED.format(source="regions") + """ SELECT name, "start", "end" FROM merged""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(tb.regions(spark, sf_dir))


@query(MERGED.format(source=f"({CLIPPED})") + """, marks AS (SELECT * FROM merged UNION ALL SELECT DISTINCT name, 0, 0 FROM regions UNION ALL SELECT DISTINCT name, 200, 200 FROM regions),
gaps AS (SELECT name, "end" AS "start", lead("start") OVER (PARTITION BY name ORDER BY "start", "end") AS "end" FROM marks)
SELECT name, "start", "end" FROM gaps WHERE "end" > "start" """)
def complement_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    return iv.complement(regions.drop("size"), _sizes(regions))


@query(R + """SELECT name, max("end") AS "start", 200 AS "end" FROM regions GROUP BY name HAVING max("end") < 200""")
def overlay_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    return iv.overlay(regions, _sizes(regions)).select("name", "start", F.col("end").cast("int").alias("end"))


@query(R + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY "start", "end", label, ord) AS rn, count(*) OVER (PARTITION BY name) AS n FROM regions),
tail AS (SELECT * FROM ranked WHERE n > 3 AND rn >= 3)
SELECT name, label, "start", "end" FROM regions r WHERE NOT EXISTS (SELECT 1 FROM tail t WHERE t.name = r.name AND t."start" = r."start" AND t."end" = r."end")
UNION ALL SELECT name, 'UNKNOWN', min("start"), arg_max("end", rn) FROM tail GROUP BY name""")
def collapse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.collapse(tb.regions(spark, sf_dir), 3)


@query(R + """SELECT name, label, "start", "end" FROM regions WHERE label = 'CODE'
UNION ALL SELECT DISTINCT name, 'UNKNOWN', CAST(0 AS BIGINT), CAST(150 AS BIGINT) FROM regions WHERE name NOT IN (SELECT name FROM regions WHERE label = 'CODE')""")
def missing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    return iv.with_fallback(regions.where("label = 'CODE'"), _sizes(regions), cap=150)


@query(R + """SELECT name, 'partitions' AS "group", 'MIDDLE' AS level, label, "start", "end" FROM regions
UNION ALL SELECT name, 'partitions', 'ROUGH', CASE label WHEN 'CODE' THEN 'OTHRSEC' WHEN 'DATA' THEN 'OTHRSEC' ELSE 'DNETSEC' END, "start", "end" FROM regions
UNION ALL SELECT name, 'characteristics', NULL, label, "start", "end" FROM regions WHERE label = 'DATA'""")
def level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    long = iv.catalogue({("partitions", "MIDDLE"): regions, ("characteristics", None): regions.where("label = 'DATA'")})
    return iv.roll_up(long, {"CODE": "OTHRSEC", "DATA": "OTHRSEC", "DNETCODE": "DNETSEC", "DNETDATA": "DNETSEC"}, "MIDDLE", "ROUGH")


@query(R + """SELECT name, 'partitions' AS "group", label AS level, label, "start", "end" FROM regions""")
def region_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    return iv.catalogue({("partitions", x): regions.where(F.col("label") == x) for x in tb.LABELS})


@query(R + """, names AS (SELECT DISTINCT name FROM regions), labels AS (SELECT unnest(['CODE', 'DATA', 'DNETCODE', 'DNETDATA']) AS label)
SELECT n.name, l.label, count(r.ord) AS n_ranges, coalesce(string_agg(r."start" || '-' || r."end", ',' ORDER BY r.ord), '') AS ranges
FROM names n CROSS JOIN labels l LEFT JOIN regions r ON r.name = n.name AND r.label = l.label GROUP BY n.name, l.label""")
def structure_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = iv.structure_maps(tb.regions(spark, sf_dir), tb.LABELS)
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return maps.select("name", "label", F.size("ranges").cast("long").alias("n_ranges"), text.alias("ranges"))


@query(R + """SELECT s.name, s."start", s."end", coalesce(bool_or(f.label = 'DATA'), false) AS "DATA", coalesce(bool_or(f.label = 'DNETDATA'), false) AS "DNETDATA"
FROM (SELECT DISTINCT name, "start", "end" FROM regions) s LEFT JOIN (SELECT * FROM regions WHERE label IN ('DATA', 'DNETDATA')) f
ON f.name = s.name AND f."start" = s."start" AND f."end" = s."end" GROUP BY s.name, s."start", s."end" """)
def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    flags = ["DATA", "DNETDATA"]
    return iv.flag_matrix(regions.select("name", "start", "end").distinct(), regions.where(F.col("label").isin(flags)), flags)


@query(R + f""", ranked AS (SELECT *, {BIT} AS mask, row_number() OVER (PARTITION BY name ORDER BY "start", "end", label, ord) AS rn FROM regions)
SELECT name, pos, CAST(bit_or(mask) AS BIGINT) AS mask FROM (SELECT name, mask, unnest(range("start", "end")) AS pos FROM ranked WHERE rn <= 2) GROUP BY name, pos""")
def mask_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.paint(iv.structure_flags(tb.regions(spark, sf_dir), tb.LABELS, first=2))


@query(R + """SELECT name, byte, CAST(bit_or(1 << CAST(pos % 8 AS INTEGER)) AS BIGINT) AS bits
FROM (SELECT name, pos, pos // 8 AS byte FROM (SELECT name, unnest(range("start", "end")) AS pos FROM regions)) GROUP BY name, byte""")
def mask_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.paint_packed(tb.regions(spark, sf_dir))


@query(MERGED.format(source="(SELECT * FROM regions WHERE label = 'CODE')") + """ SELECT name, "start", "end" FROM merged""")
def runs_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = tb.regions(spark, sf_dir).where("label = 'CODE'").withColumn("mask", F.lit(1).cast("long"))
    return iv.runs(iv.paint(code))


@query(R + f""", edges AS (SELECT DISTINCT name, unnest(["start", "end"]) AS "start" FROM regions), cut AS (SELECT name, "start", lead("start") OVER (PARTITION BY name ORDER BY "start") AS "end" FROM edges)
SELECT c.name, c."start", c."end", CAST(bit_or({BIT}) AS BIGINT) AS mask FROM cut c JOIN regions r ON r.name = c.name AND c."start" >= r."start" AND c."start" < r."end"
WHERE c."end" IS NOT NULL GROUP BY c.name, c."start", c."end" """)
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.segments(iv.structure_flags(tb.regions(spark, sf_dir), tb.LABELS))


@query(R + """SELECT a.name, a.ord, b.ord AS r_ord FROM regions a JOIN regions b ON a.name = b.name AND a."start" < b."end" AND b."start" < a."end" WHERE a.label = 'CODE' AND b.label = 'DATA'""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir).drop("size")
    return iv.overlap_join(regions.where("label = 'CODE'"), regions.where("label = 'DATA'")).select("name", "ord", "r_ord")


@query(R + """SELECT name, ord, "start", "end" FROM regions a WHERE label = 'CODE' AND EXISTS (SELECT 1 FROM regions b WHERE a.name = b.name AND b.label = 'DATA' AND a."start" < b."end" AND b."start" < a."end")""")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir).drop("size")
    return iv.overlap_join(regions.where("label = 'CODE'"), regions.where("label = 'DATA'"), how="left_semi").select("name", "ord", "start", "end")


@query(R + """, points AS (SELECT o_orderkey AS name, CAST(o_custkey % 200 AS BIGINT) AS pos FROM orders)
SELECT p.name, p.pos, r.ord, r.label FROM points p JOIN regions r ON r.name = p.name AND p.pos >= r."start" AND p.pos < r."end" """)
def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), (F.col("o_custkey") % 200).cast("long").alias("pos"))
    return iv.point_join(points, tb.regions(spark, sf_dir)).select("name", "pos", "ord", "label")


@query(f"""WITH {tb.LINE_REGIONS_SQL} SELECT r.name, r.label, CAST(sum(r."end" - r."start") AS BIGINT) AS n_bytes,
sha256(string_agg(d.parts[r.ord + 1], '' ORDER BY r.ord)) AS digest FROM line_regions r JOIN (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d ON d.doc_id = r.name GROUP BY r.name, r.label""")
def slice_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = iv.slice_blobs(tb.samples(spark, sf_dir), tb.line_regions(spark, sf_dir))
    return sliced.select("name", "label", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query(f"""WITH {tb.LINE_REGIONS_SQL} SELECT name, name // 16 AS batch, label, "start", row_number() OVER (PARTITION BY name ORDER BY "start", label, ord) - 1 AS pos,
row_number() OVER (PARTITION BY name // 16, label ORDER BY name, ord) - 1 AS local FROM line_regions WHERE "start" < 5000""")
def region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = iv.region_order(tb.line_regions(spark, sf_dir), F.floor(F.col("name") / 16), F.lit(5000))
    return ordered.select("name", "batch", "label", "start", "pos", "local")


@query(f"""WITH {tb.LINE_REGIONS_SQL} SELECT name, CAST(count(*) AS BIGINT) AS n, md5(string_agg(CAST("end" - "start" AS VARCHAR), ',' ORDER BY "start")) AS lengths FROM line_regions GROUP BY name""")
def reassembled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = iv.region_order(tb.line_regions(spark, sf_dir), F.floor(F.col("name") / 16))
    results = ordered.select("batch", "label", "local", (F.col("end") - F.col("start")).alias("value"))
    back = iv.reassemble(results, ordered.select("name", "batch", "label", "local", "pos"))
    dense = iv.packed_order(iv.dense_order(F.col("values"), 64, "keep"))
    return back.select("name", F.size(dense).cast("long").alias("n"), F.md5(F.array_join(F.transform(dense, lambda x: x.cast("string")), ",")).alias("lengths"))


@query(f"""WITH {tb.LINE_REGIONS_SQL}, r AS (SELECT name, "end" - "start" AS v, row_number() OVER (PARTITION BY name ORDER BY "start", label, ord) AS pos FROM line_regions), n AS (SELECT name, count(*) AS n FROM r GROUP BY name),
f AS (SELECT name, unnest(range(1, 41)) AS pos FROM n) SELECT f.name, string_agg(CAST(coalesce(r.v, -1) AS VARCHAR), ',' ORDER BY f.pos) AS lengths FROM f LEFT JOIN r ON r.name = f.name AND r.pos = f.pos GROUP BY f.name""")
def dense_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of 40 places: shorter orders are filled up, longer ones are cut."""
    ordered = iv.region_order(tb.line_regions(spark, sf_dir), F.floor(F.col("name") / 16))
    results = ordered.select("batch", "label", "local", (F.col("end") - F.col("start")).alias("value"))
    back = iv.reassemble(results, ordered.select("name", "batch", "label", "local", "pos"))
    dense = iv.dense_order(F.col("values"), 40, "ignore")
    return back.select("name", F.array_join(F.transform(dense, lambda x: x.cast("string")), ",").alias("lengths"))


@query("""WITH found AS (SELECT page_id AS name, html, unnest(['head', 'script', 'style']) AS label FROM pages),
parts AS (SELECT name, label, regexp_extract_all(html, '(?s)<' || label || '.*?</' || label || '>') AS found, regexp_split_to_array(html, '(?s)<' || label || '.*?</' || label || '>') AS between FROM found),
e AS (SELECT name, label, found, between, unnest(range(1, len(found) + 1)) AS k FROM parts)
SELECT name, label, CAST(list_sum(list_transform(between[1:k], lambda x: octet_length(encode(x)))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: octet_length(encode(x)))), 0) AS BIGINT) AS "start",
CAST(list_sum(list_transform(between[1:k], lambda x: octet_length(encode(x)))) + list_sum(list_transform(found[1:k], lambda x: octet_length(encode(x)))) AS BIGINT) AS "end" FROM e""")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of all head, script and style elements of every page."""
    pages = tb.read(spark, sf_dir, "pages").select(F.col("page_id").alias("name"), "html")
    found = None
    for label in ("head", "script", "style"):
        pattern = f"(?s)<{label}.*?</{label}>"
        rows = pages.select("name", F.lit(label).alias("label"), F.regexp_extract_all("html", F.lit(pattern), F.lit(0)).alias("found"), F.split("html", pattern, -1).alias("between"))
        rows = rows.select("name", "label", F.posexplode(F.arrays_zip(F.slice("between", F.lit(1), F.size("found")).alias("between"), "found")).alias("k", "p"))
        gap, own = F.octet_length("p.between"), F.octet_length("p.found")
        end = F.sum(gap + own).over(Window.partitionBy("name", "label").orderBy("k"))
        rows = rows.select("name", "label", (end - own).cast("long").alias("start"), end.cast("long").alias("end"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(R + """SELECT label, count(*) AS n, sum("end" - "start") AS n_bytes, avg(CASE WHEN ord = 1 THEN 1.0 ELSE 0.0 END) AS share_first FROM regions GROUP BY label""")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = tb.regions(spark, sf_dir)
    return regions.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.avg(F.when(F.col("ord") == 1, 1.0).otherwise(0.0)).alias("share_first"))
