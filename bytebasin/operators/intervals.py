"""Algebra of half-open ranges: one row a range, (name, label, start, end), ``name`` being the blob it lies on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytebasin.operators.bitmaps import bytes_of, words_of_ranges


def clip(regions: DataFrame, limit: Column | str = "size") -> DataFrame:
    """Ranges cut to [0, limit); empty ones go."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    cut = regions.withColumns({"start": F.greatest(F.lit(0).cast("long"), "start"), "end": F.least(limit, F.col("end"))})
    return cut.where("end > start")


def trim(regions: DataFrame, length: int) -> DataFrame:
    """Ranges as they are in a blob cut to ``length``: those beyond go, the last is cut."""
    return regions.where(F.col("start") < length).withColumn("end", F.least("end", F.lit(length).cast("long")))


def cap_lengths(regions: DataFrame, cap: int) -> DataFrame:
    """Every range cut to ``cap`` positions from its start; ``cap`` must be positive."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    return regions.withColumn("end", F.least("end", F.col("start") + cap))


def merge(regions: DataFrame, keys: Iterable[str] = ("name",)) -> DataFrame:
    """Overlapping or adjoining ranges of a key as one: islands between gaps of the running end."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    islands = regions.select(*keys, "start", "end").withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """What no range covers within [0, size); ``sizes`` is (name, size), with blobs that have no range at all."""
    merged = merge(clip(regions.join(sizes, "name")))
    ends = sizes.select("name", F.col("size").alias("start"), F.col("size").alias("end"))
    begin = sizes.select("name", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    order = Window.partitionBy("name").orderBy("start", "end")
    gaps = merged.unionByName(begin).unionByName(ends).select("name", F.col("end").alias("start"), F.lead("start").over(order).alias("end"))
    return gaps.where("end > start")


def overlay(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """The tail behind the last range's end, the whole blob where it has no range."""
    last = regions.groupBy("name").agg(F.max("end").alias("start"))
    tail = sizes.join(last, "name", "left").select("name", F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.col("size").alias("end"))
    return tail.where("end > start")


def collapse(regions: DataFrame, most: int, unknown: str = "UNKNOWN") -> DataFrame:
    """At most ``most`` ranges a blob, by start: the rest become one ``unknown`` range.

    It reaches from the start of the first range replaced to the end of the last one by start. Removal goes by the
    range's value, so a kept range equal to a replaced one goes too.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    order = Window.partitionBy("name").orderBy("start", "end", "label", "ord")
    ranked = regions.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("name")))
    tail = ranked.where((F.col("n") > most) & (F.col("rn") >= most))
    gone = tail.select("name", "start", "end").distinct()
    kept = regions.join(gone, ["name", "start", "end"], "left_anti").select("name", "label", "start", "end")
    rest = tail.groupBy("name").agg(F.min("start").alias("start"), F.max_by("end", "rn").alias("end"))
    return kept.unionByName(rest.select("name", F.lit(unknown).alias("label"), "start", "end"))


def with_fallback(regions: DataFrame, sizes: DataFrame, cap: int | None = None, unknown: str = "UNKNOWN") -> DataFrame:
    """Blobs without a range get one ``unknown`` range over all of them, or over their first ``cap`` positions."""
    missing = sizes.join(regions.select("name").distinct(), "name", "left_anti")
    end = F.least("size", F.lit(cap).cast("long")) if cap else F.col("size")
    extra = missing.select("name", F.lit(unknown).alias("label"), F.lit(0).cast("long").alias("start"), end.alias("end"))
    return regions.select("name", "label", "start", "end").unionByName(extra)


def roll_up(regions: DataFrame, mapping: dict[str, str], level: str, new: str) -> DataFrame:
    """The rows of ``level`` again under ``new``, relabelled; rows of other levels stay, old rows of ``new`` go."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    derived = regions.where(F.col("level") == level).withColumns({"level": F.lit(new), "label": F.coalesce(pairs[F.col("label")], F.col("label"))})
    return regions.where(F.col("level").isNull() | (F.col("level") != new)).unionByName(derived)


def catalogue(parts: dict[tuple[str, str | None], DataFrame]) -> DataFrame:
    """One long table (name, group, level, label, start, end) of several tables of ranges, by (group, level)."""
    out = None
    for (group, level), df in parts.items():
        rows = df.select("name", F.lit(group).alias("group"), F.lit(level).cast("string").alias("level"), "label", "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out


def structure_maps(regions: DataFrame, labels: Iterable[str]) -> DataFrame:
    """For each blob and every label of a fixed list its ranges in ``ord``, as an array; empty ones are kept."""
    labels = list(labels)
    of = [F.array_sort(F.collect_list(F.when(F.col("label") == x, F.struct("ord", "start", "end")))) for x in labels]
    wide = regions.groupBy("name").agg(*[a.alias(f"c{i}") for i, a in enumerate(of)])
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(x).alias("label"), F.transform(f"c{i}", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("ranges")) for i, x in enumerate(labels)])
    return wide.select("name", F.inline(pairs))


def flag_matrix(sections: DataFrame, flags: DataFrame, names: Iterable[str]) -> DataFrame:
    """A boolean column for each flag: whether a flag row has exactly the section's name, start and end."""
    wide = flags.groupBy("name", "start", "end").agg(*[F.max(F.col("label") == x).alias(x) for x in names])
    joined = sections.join(wide, ["name", "start", "end"], "left")
    return joined.withColumns({x: F.coalesce(x, F.lit(False)) for x in names})


def structure_flags(regions: DataFrame, labels: Iterable[str], first: int | None = None) -> DataFrame:
    """Ranges with ``mask``, the bit of their label's place in the list; of each blob the ``first`` by start if given."""
    bits = {x: 1 << i for i, x in enumerate(labels)}
    pairs = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    out = regions.withColumn("mask", pairs[F.col("label")].cast("long"))
    if first is not None:
        order = Window.partitionBy("name").orderBy("start", "end", "label", "ord")
        out = out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first).drop("rn")
    return out


def paint(regions: DataFrame) -> DataFrame:
    """A row for each covered position, with the masks of its ranges joined: (name, pos, mask).

    Ranges are painted by words of 64 positions, those of one mask together; positions come out of the joined words.
    """
    words = words_of_ranges(regions, ["name", "mask"]).groupBy("name", "word", "mask").agg(F.bit_or("bits").alias("bits"))
    met = words.groupBy("name", "word").agg(F.collect_list(F.struct("mask", "bits")).alias("layers"))
    of = lambda k: F.aggregate("layers", F.lit(0).cast("long"), lambda m, x: F.when(F.getbit(x["bits"], k) == 1, m.bitwiseOR(x["mask"])).otherwise(m))
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct((F.col("word") * 64 + k).alias("pos"), of(k).alias("mask")))
    return met.select("name", F.inline(F.filter(every, lambda p: p["mask"] != 0)))


def paint_packed(regions: DataFrame, keys: Iterable[str] = ("name",)) -> DataFrame:
    """Eight positions a byte, the lowest bit first: (keys, byte, bits). Ranges are joined by words of 64 positions."""
    keys = list(keys)
    words = words_of_ranges(regions, keys).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    return bytes_of(words.withColumn("known", F.col("bits")), *keys)


def runs(positions: DataFrame, keys: Iterable[str] = ("name",)) -> DataFrame:
    """Consecutive positions of a key as ranges."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("pos")
    grouped = positions.select(*keys, "pos").distinct().withColumn("island", F.col("pos") - F.row_number().over(order))
    return grouped.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def segments(regions: DataFrame) -> DataFrame:
    """Disjoint segments between all boundaries of a blob, with the masks of what covers them joined.

    A sweep: ranges of one bit are merged, so a bit turns at the start and at the end of each, and the mask of a segment
    is what has turned an odd number of times before it. No range meets another one.
    """
    # up to a mask's highest bit, of which few are in use as a rule
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.length(F.bin("mask")) - 1), lambda k: F.getbit("mask", k) == 1))
    by_bit = merge(regions.where("end > start").select("name", "start", "end", bit.alias("bit")), ["name", "bit"])
    turns = by_bit.select("name", F.explode(F.array("start", "end")).alias("start"), F.expr("shiftleft(1L, bit)").alias("turn"))
    edges = regions.select("name", F.explode(F.array("start", "end")).alias("start"), F.lit(0).cast("long").alias("turn"))
    order = Window.partitionBy("name").orderBy("start")
    points = turns.unionByName(edges).groupBy("name", "start").agg(F.bit_xor("turn").alias("turn"))
    mask = F.bit_xor("turn").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return points.select("name", "start", F.lead("start").over(order).alias("end"), mask.alias("mask")).where("end IS NOT NULL AND mask <> 0")


#: Sizes of the buckets in which ranges are met: the least, and how many times larger each next one is.
LEAST_BUCKET, GROWTH = 64, 16


def _bucket_sizes(*tables: DataFrame) -> list[int]:
    """The bucket sizes that hold the ranges' lengths, those alone that some range needs; one job over all tables."""
    every = [LEAST_BUCKET]
    while every[-1] < 1 << 62:
        every.append(min(1 << 62, every[-1] * GROWTH))
    lengths = reduce(DataFrame.union, [t.select((F.col("end") - F.col("start")).alias("n")) for t in tables]).where("n > 0")
    holds = F.get(F.filter(F.array(*[F.lit(s).cast("long") for s in every]), lambda s: s >= F.col("n")), 0)
    return sorted(lengths.agg(F.collect_set(holds)).first()[0] or [LEAST_BUCKET])


def _in_buckets(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Ranges with ``__own``, the least size that holds their length, and a row for each bucket (``__size``, ``__b``) of
    this and every larger size that they touch: two of a size at most, however long they are."""
    length = F.col("end") - F.col("start")
    own = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s >= length)
    rows = df.where("end > start").withColumn("__sizes", own).withColumn("__own", F.get("__sizes", F.lit(0)))
    rows = rows.withColumn("__size", F.explode("__sizes")).drop("__sizes")
    return rows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / F.col("__size")), F.floor((F.col("end") - 1) / F.col("__size")))))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "name", how: str = "inner") -> DataFrame:
    """Pairs of ranges of one key that overlap, as (left columns, r_ columns); ``left_semi`` keeps left rows that do.

    Ranges are met by key and bucket, in buckets as large as the longer range of a pair needs, and a pair is taken in the
    bucket where the later of the two begins: an equality join with a small residue in place of a product, in which a
    long range takes no more rows than a short one.
    """
    sizes = _bucket_sizes(left, right)
    r = _in_buckets(right.select(*[F.col(c).alias(c if c in ("start", "end") else f"r_{c}") for c in right.columns]), sizes)
    r = r.withColumnsRenamed({"start": "r_start", "end": "r_end", "__b": "r__b", "__own": "r__own", "__size": "r__size"})
    lft = left if how == "inner" else left.withColumn("__id", F.monotonically_increasing_id())
    where = (F.col(key) == F.col(f"r_{key}")) & (F.col("__size") == F.col("r__size")) & (F.col("__b") == F.col("r__b"))
    where &= (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("__size") == F.greatest("__own", "r__own"))
    where &= F.col("__b") == F.floor(F.greatest("start", "r_start") / F.col("__size"))
    if how == "inner":
        return _in_buckets(left, sizes).join(r, where).drop("__b", "r__b", "__own", "r__own", "__size", "r__size")
    return _in_buckets(lft, sizes).join(r, where, "left_semi").dropDuplicates(["__id"]).drop("__id", "__b", "__own", "__size")


def point_join(points: DataFrame, regions: DataFrame, key: str = "name") -> DataFrame:
    """Points (key, pos, ...) with every range of their key that holds them; a range is met in buckets of its own size."""
    sizes = _bucket_sizes(regions)
    cut = _in_buckets(regions, sizes).where(F.col("__size") == F.col("__own")).drop("__own")
    dealt = points.withColumn("__size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    dealt = dealt.withColumn("__b", F.floor(F.col("pos") / F.col("__size")))
    return dealt.join(cut, [key, "__size", "__b"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).drop("__b", "__size")


def _piece(start: Column, end: Column) -> Column:
    return F.substring(F.col("data"), (start + 1).cast("int"), (end - start).cast("int"))


def cut_pieces(samples: DataFrame, regions: DataFrame, *columns: Column | str) -> DataFrame:
    """(name, columns, piece): the bytes of every range.

    A blob is joined once with all its ranges, which are put together first, and cut in its row: it isn't copied for
    each of them.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    row = F.struct(F.struct(*columns).alias("of"), "start", "end")
    ranges = regions.groupBy("name").agg(F.collect_list(row).alias("ranges"))
    met = samples.select("name", "data").join(ranges, "name")
    pieces = F.transform("ranges", lambda r: F.struct(r["of"].alias("of"), _piece(r["start"], r["end"]).alias("piece")))
    return met.select("name", F.inline(pieces)).select("name", "of.*", "piece")


def slice_blobs(samples: DataFrame, regions: DataFrame, keys: Iterable[str] = ("name", "label")) -> DataFrame:
    """The bytes of a key's ranges one after another in ``ord``; ranges of no bytes give empty pieces.

    ``keys`` begin with the name. Ranges are put together by blob first, so that a blob is joined once and cut in its row.
    """
    _, *others = keys
    ranges = regions.groupBy("name", *others).agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))).alias("ranges"))
    by_name = ranges.groupBy("name").agg(F.collect_list(F.struct(F.struct("name", *others).alias("of"), "ranges")).alias("groups"))

    def joined(group: Column) -> Column:
        return F.aggregate(group["ranges"], F.lit(b"").cast("binary"), lambda acc, r: F.concat(acc, _piece(r["start"], r["end"])))

    cut = F.transform("groups", lambda g: F.struct(g["of"].alias("of"), joined(g).alias("data")))
    met = samples.select("name", "data").join(by_name, "name")
    return met.select(F.inline(cut)).select("of.*", "data")


def region_order(regions: DataFrame, batch: Column, length: Column | None = None) -> DataFrame:
    """Ranges of a blob by start, with ``(label, local)``: ``local`` counts a label's ranges throughout a batch.

    Ranges that begin at or behind ``length``, or end before they start, go.
    """
    kept = regions.where("start <= end").withColumn("batch", batch)
    if length is not None:
        kept = kept.where(F.col("start") < length)
    by_name = Window.partitionBy("name").orderBy("start", "label", "ord")
    by_label = Window.partitionBy("batch", "label").orderBy("name", "ord")
    return kept.withColumns({"pos": F.row_number().over(by_name).cast("long") - 1, "local": F.row_number().over(by_label).cast("long") - 1})


def dense_order(order: Column, size: int, overflow: str = "raise") -> Column:
    """An array padded with -1 to ``size``; a longer one raises an error, is cut (``ignore``) or kept (``keep``)."""
    padded = F.concat(order, F.array_repeat(F.lit(-1).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size(order))))
    if overflow == "raise":
        return F.when(F.size(order) > size, F.raise_error(F.lit("order longer than its array"))).otherwise(padded)
    return F.slice(padded, 1, size) if overflow == "ignore" else padded


def packed_order(dense: Column) -> Column:
    """The array without its padding."""
    return F.filter(dense, lambda x: x != -1)


def reassemble(results: DataFrame, ordered: DataFrame) -> DataFrame:
    """Results of (batch, label, local) put back in the order of their blob: (name, values)."""
    joined = ordered.join(results, ["batch", "label", "local"], "left")
    return joined.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
