"""Portable executables as tables: headers, sections, data directories and labelled ranges, read in DataFrame functions.

A blob is read once, in its row: its headers become a struct, its section table and data directories arrays of structs.
Addresses are mapped, ranges clipped, managed sections met and what is left complemented by functions on these arrays,
so that no step joins or shuffles; one generator at the end gives rows. Numbers are little-endian. Inputs are
(name, data).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytebasin.functions.scalars import once
from bytebasin.operators.intervals import clip

# Fixed values of the file format.
E_LFANEW, COFF_SIZE, SECTION_SIZE, DOS_SIZE = 0x3C, 20, 40, 64
PE32_PLUS = 0x20B
EXECUTE, READ, WRITE = 0x20000000, 0x40000000, 0x80000000
#: Offset of the number of directories in the optional header, by format; the directories follow it.
DIRECTORIES_AT = {False: 92, True: 108}
DIRECTORIES = (
    "EXPORT", "IMPORT", "RESOURCE", "EXCEPTION", "CERTIFICATE", "RELOCATION", "DEBUG", "ARCHITECTURE",
    "GLOBAL", "TLS", "LOADCONFIG", "BOUND", "IAT", "DELAY", "CLR", "RESERVED",
)
CERTIFICATE, CLR = 4, 14
#: The CLR header's size, and its (address, size) pairs by offset.
CLR_SIZE = 72
CLR_PAIRS = (8, 24, 32, 40, 48, 56, 64)
FLAGS = {
    "CNT_CODE": 0x20, "CNT_INITIALIZED_DATA": 0x40, "CNT_UNINITIALIZED_DATA": 0x80, "LNK_INFO": 0x200, "LNK_REMOVE": 0x800,
    "LNK_COMDAT": 0x1000, "GPREL": 0x8000, "LNK_NRELOC_OVFL": 0x1000000, "MEM_DISCARDABLE": 0x2000000, "MEM_NOT_CACHED": 0x4000000,
    "MEM_NOT_PAGED": 0x8000000, "MEM_SHARED": 0x10000000, "MEM_EXECUTE": EXECUTE, "MEM_READ": READ, "MEM_WRITE": WRITE,
}
#: Labels of directories at the finest level; the others are OTHERDIR.
FINE_DIRECTORIES = {
    "IMPORT": "IDATA", "DELAY": "DELAYIMP", "EXPORT": "EDATA", "RESOURCE": "RESOURCE", "TLS": "TLS", "LOADCONFIG": "LOADCFG",
    "RELOCATION": "RELOC", "DEBUG": "DEBUG", "CLR": "CLR",
}
#: Bytes from the signature on that hold the COFF header, the optional header's fields and all directories.
HEAD = 24 + DIRECTORIES_AT[True] + 4 + 8 * len(DIRECTORIES)
SIGNATURE = b"PE\0\0"
#: The header's fields that are kept, (offset from the signature, bytes); ``plus`` is told by the format's number.
FIELDS = {"machine": (4, 2), "n_sections": (6, 2), "timestamp": (8, 4), "optional_size": (20, 2), "headers_size": (84, 4), "plus": (24, 2)}


def _has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("long")) != 0


def _number(data: Column, at: Column | int, width: int) -> Column:
    """The number of ``width`` bytes at a byte of binary data, null beyond its end. Offsets are named once a byte, so
    give it values, not expressions."""
    at = F.lit(at) if isinstance(at, int) else at
    high_first = F.concat(*[F.substring(data, (at + 1 + i).cast("int"), F.lit(1)) for i in reversed(range(width))])
    return F.when(F.length(data) >= at + width, F.conv(F.hex(high_first), 16, 10).cast("long"))


def _bytes(offset: Column | int, width: int, size: Column | None = None) -> Column:
    """Bytes of ``data`` from an offset on; none beyond its end, however far the offset."""
    last = F.length("data") if size is None else size
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring("data", (F.least(offset.cast("long"), last.cast("long")) + 1).cast("int"), F.lit(width))


def _count(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))


def _cut(ranges: Column, size: Column) -> Column:
    """Structs with ``start`` and ``end`` cut to the file; empty ones go."""
    inside = F.transform(ranges, lambda r: r.withField("start", F.greatest(F.lit(0).cast("long"), r["start"])).withField("end", F.least(size, r["end"])))
    return F.filter(inside, lambda r: r["end"] > r["start"])


def _offset(rva: Column, sections: Column) -> Column:
    """The place in the file of an address, by the first section that holds it."""
    holder = F.get(F.filter(sections, lambda s: (rva >= s["vaddr"]) & (rva < s["vaddr"] + s["vsize"])), 0)
    return rva - holder["vaddr"] + holder["raw_off"]


def _mapped(pairs: Column, sections: Column) -> Column:
    """(rva, length, ...) structs that have a place in the file, with ``start`` and ``end``."""
    placed = F.transform(F.filter(pairs, lambda p: (p["rva"] != 0) & (p["length"] != 0)), lambda p: p.withField("start", F.when(p["fixed"], p["rva"]).otherwise(_offset(p["rva"], sections))))
    return F.filter(F.transform(placed, lambda p: p.withField("end", p["start"] + p["length"])), lambda p: p["end"].isNotNull())


def _heads(blobs: DataFrame) -> DataFrame:
    """A row for each executable: ``blobs`` with ``size``, ``head``, the bytes from its signature on, and ``FIELDS``."""
    size = F.col("size")
    rows = once(blobs.where(F.substring("data", 1, 2) == F.lit(b"MZ")), e_lfanew=_number(_bytes(E_LFANEW, 4), 0, 4), size=F.length("data").cast("long"))
    rows = once(rows, head=_bytes(F.col("e_lfanew"), HEAD, size)).where(F.substring("head", 1, 4) == F.lit(SIGNATURE))
    fields = {n: _number(F.col("head"), at, width) for n, (at, width) in FIELDS.items()}
    return once(rows, **{**fields, "plus": fields["plus"] == PE32_PLUS})


def parsed(blobs: DataFrame) -> DataFrame:
    """A row for each executable: ``name``, ``size``, the header's fields, ``sections`` and ``directories``.

    ``sections`` are (sec_no, vaddr, vsize, raw_off, raw_size, flags, managed), entries beyond the file's end left out;
    ``managed`` tells whether a section meets the CLR header or what that points to. ``directories`` are (dir, label,
    start, end), those that have a place in the file. A blob without the two signatures has no row.
    """
    size, head = F.col("size"), F.col("head")
    rows = _heads(blobs)
    table, at = F.col("e_lfanew") + 24 + F.col("optional_size"), F.when(F.col("plus"), 24 + DIRECTORIES_AT[True]).otherwise(24 + DIRECTORIES_AT[False])
    rows = once(rows, table=table, at=at.cast("long"))
    within = F.least("n_sections", F.floor((F.col("size") - F.col("table")) / SECTION_SIZE))
    rows = once(rows, entries=F.transform(_count(within), lambda i: _bytes(F.col("table") + i * SECTION_SIZE, SECTION_SIZE, size)), n_dirs=F.least(F.lit(len(DIRECTORIES)).cast("long"), _number(head, F.col("at"), 4)))
    of_section = (("vaddr", 12), ("vsize", 8), ("raw_off", 20), ("raw_size", 16), ("flags", 36))
    sections = F.transform("entries", lambda h, i: F.struct(i.cast("long").alias("sec_no"), *[_number(h, o, 4).alias(n) for n, o in of_section]))
    names = F.array(*map(F.lit, DIRECTORIES))
    pair = lambda data, o: (_number(data, o, 4).alias("rva"), _number(data, o + 4, 4).alias("length"))
    listed = F.transform(_count(F.coalesce("n_dirs", F.lit(0).cast("long"))), lambda k: F.struct(k.alias("dir"), F.get(names, k.cast("int")).alias("label"), *pair(head, F.col("at") + 4 + k * 8), (k == CERTIFICATE).alias("fixed")))
    rows = once(rows, sections=sections, listed=listed).drop("entries", "n_dirs", "table", "at", "head")
    rows = once(rows, placed=_mapped(F.col("listed"), F.col("sections"))).drop("listed")
    clr = F.get(F.filter("placed", lambda d: d["dir"] == CLR), 0)
    rows = once(rows, clr=clr)
    rows = once(rows, clr_head=F.rpad(_bytes(F.col("clr.start"), CLR_SIZE, size), F.lit(CLR_SIZE), F.lit(b"\0")))
    pairs = F.transform(F.array(*map(F.lit, CLR_PAIRS)), lambda o: F.struct(*pair(F.col("clr_head"), o), F.lit(False).alias("fixed")))
    spans = F.transform(_mapped(pairs, F.col("sections")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    own = F.array(F.struct(F.col("clr.start").alias("start"), F.col("clr.end").alias("end")))
    rows = once(rows.drop("data"), spans=F.when(F.col("clr").isNotNull(), F.concat(own, spans)).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)")))
    met = lambda s: F.exists("spans", lambda m: (s["raw_size"] != 0) & (s["raw_off"] < m["end"]) & (m["start"] < s["raw_off"] + s["raw_size"]))
    found = {
        "sections": F.transform("sections", lambda s: s.withField("managed", met(s))),
        "directories": _cut(F.transform("placed", lambda d: F.struct(*[d[c].alias(c) for c in ("dir", "label", "start", "end")])), F.col("size")),
    }
    return once(rows, **found).select("name", "size", "e_lfanew", *FIELDS, "sections", "directories")


def headers(blobs: DataFrame) -> DataFrame:
    """(name, size, e_lfanew, machine, n_sections, timestamp, optional_size, headers_size, plus) of each executable."""
    return _heads(blobs).select("name", "size", "e_lfanew", *FIELDS)


def sections(blobs: DataFrame) -> DataFrame:
    """(name, sec_no, vaddr, vsize, raw_off, raw_size, flags, managed, size) of every entry of the section table."""
    return parsed(blobs).select("name", F.inline("sections"), "size")


def section_ranges(secs: DataFrame) -> DataFrame:
    """(name, sec_no, flags, start, end): raw ranges of sections that have bytes, cut to the file."""
    rows = secs.where("raw_size <> 0").select("name", "sec_no", "flags", F.col("raw_off").alias("start"), (F.col("raw_off") + F.col("raw_size")).alias("end"), "size")
    return clip(rows)


def directories(blobs: DataFrame) -> DataFrame:
    """(name, dir, label, start, end) of the data directories; the certificate table's address is an offset already."""
    return parsed(blobs).select("name", F.inline("directories"))


def managed_sections(blobs: DataFrame) -> DataFrame:
    """(name, sec_no) of sections that meet the CLR header or what it points to."""
    return sections(blobs).where("managed").select("name", "sec_no")


def _header_parts() -> Column:
    """(label, start, end) of all headers, and of the parts of them."""
    e, zero = F.col("e_lfanew"), F.lit(0).cast("long")
    table = e + 24 + F.col("optional_size")
    parts = [
        ("HEADERS", zero, F.col("headers_size")), ("DOS_HEADER", zero, F.lit(DOS_SIZE).cast("long")), ("DOS_STUB", F.lit(DOS_SIZE).cast("long"), e),
        ("COFF_HEADER", e + 4, e + 4 + COFF_SIZE), ("OPTN_HEADER", e + 24, table), ("SECTN_TABLE", table, table + F.col("n_sections") * SECTION_SIZE),
    ]
    return _cut(F.array(*[F.struct(F.lit(n).alias("label"), s.alias("start"), x.alias("end")) for n, s, x in parts]), F.col("size"))


def header_ranges(blobs: DataFrame) -> DataFrame:
    """(name, label, start, end): all headers, and the parts of them."""
    return _heads(blobs).select("name", F.inline(_header_parts()))


def flag_ranges(ranges: DataFrame, flags: dict[str, int] = FLAGS) -> DataFrame:
    """(name, label, start, end): a row for each flag that a section carries."""
    names = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(m).cast("long").alias("mask")) for n, m in flags.items()])
    rows = ranges.withColumn("f", F.explode(names)).where(F.col("flags").bitwiseAND(F.col("f.mask")) != 0)
    return rows.select("name", F.col("f.label").alias("label"), "start", "end")


def section_class(flags: Column) -> Column:
    """CODE if it executes, DATA if it is read and does not, else OTHER; what a section is said to hold is passed over."""
    return F.when(_has(flags, EXECUTE), "CODE").when(_has(flags, READ), "DATA").otherwise("OTHER")


def section_class_rw(flags: Column, managed: Column | None = None) -> Column:
    """CODE and DATA, those of managed sections with DNET before them, all with W if they may be written and else R."""
    kind = section_class(flags)
    whose = F.when(managed, "DNET").otherwise("") if managed is not None else F.lit("")
    return F.when(kind == "OTHER", kind).otherwise(F.concat(F.when(_has(flags, WRITE), "W").otherwise("R"), whose, kind))


def _gaps(ranges: Column, size: Column) -> Column:
    """What sorted ranges leave of [0, size): a fold that carries how far they reach and the gaps before."""
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)")
    start = F.struct(F.lit(0).cast("long").alias("upto"), nothing.alias("gaps"))
    gap = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    step = lambda done, r: F.struct(
        F.greatest(done["upto"], r["end"]).alias("upto"), F.when(r["start"] > done["upto"], F.concat(done["gaps"], gap(done["upto"], r["start"]))).otherwise(done["gaps"]).alias("gaps")
    )
    return F.aggregate(ranges, start, step, lambda done: F.when(done["upto"] < size, F.concat(done["gaps"], gap(done["upto"], size))).otherwise(done["gaps"]))


def structures(blobs: DataFrame) -> DataFrame:
    """(name, group, level, label, start, end): the structures of executables at four levels, and section flags.

    COARSE has headers, sections, overlay, directories and all other bytes; ROUGH tells managed sections from the rest;
    MIDDLE tells code from data, and a section that is neither has no row from there on; FINE has the parts of the
    headers, sections by access, and directories by kind.
    """
    size = F.col("size")
    span = lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))
    raw = F.transform(F.filter("sections", lambda s: s["raw_size"] != 0), lambda s: F.struct(s["raw_off"].alias("start"), (s["raw_off"] + s["raw_size"]).alias("end"), s["flags"].alias("flags"), s["managed"].alias("managed"), (s["raw_off"] != 0).alias("placed")))
    rows = once(parsed(blobs), raw=raw, parts=_header_parts())
    last = F.coalesce(F.array_max(F.transform(F.filter("raw", lambda s: s["placed"]), lambda s: s["end"])), F.lit(0).cast("long"))
    rows = once(rows, secs=_cut(F.col("raw"), size), tail=_cut(F.array(F.struct(last.alias("start"), size.alias("end"))), size), heads=F.filter("parts", lambda p: p["label"] == "HEADERS"))
    taken = F.concat(*[F.transform(c, span) for c in ("heads", "secs", "tail", "directories")])
    rows = once(rows, rest=_gaps(F.array_sort(taken), size))

    def of(level: str, ranges: str, label: Callable[[Column], Column]) -> Column:
        row = lambda r: F.struct(F.lit("partitions").alias("group"), F.lit(level).alias("level"), label(r).alias("label"), r["start"].alias("start"), r["end"].alias("end"))
        return F.transform(ranges, row)

    def named(label: str) -> Callable[[Column], Column]:
        return lambda r: F.lit(label)

    whose = lambda s: F.when(s["managed"], "DNET").otherwise("")
    fine_dirs = F.create_map(*[F.lit(x) for pair in FINE_DIRECTORIES.items() for x in pair])
    classes = {
        "COARSE": named("SECTION"), "ROUGH": lambda s: F.when(s["managed"], "DNETSEC").otherwise("OTHRSEC"),
        "MIDDLE": lambda s: F.when(section_class(s["flags"]) != "OTHER", F.concat(whose(s), section_class(s["flags"]))),
        "FINE": lambda s: F.when(section_class(s["flags"]) != "OTHER", section_class_rw(s["flags"], s["managed"])),
    }
    parts = []
    for level, of_section in classes.items():
        fine = level == "FINE"
        parts.append(F.transform(F.filter("parts", lambda p: p["label"] != "HEADERS"), lambda p: F.struct(F.lit("partitions").alias("group"), F.lit("FINE").alias("level"), p["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end"))) if fine else of(level, "heads", named("HEADERS")))
        parts += [of(level, "secs", of_section), of(level, "tail", named("OVERLAY")), of(level, "rest", named("OTHER"))]
        parts.append(of(level, "directories", (lambda d: F.coalesce(fine_dirs[d["label"]], F.lit("OTHERDIR"))) if fine else named("DIRECTORY")))
    masks = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(m).cast("long").alias("mask")) for n, m in FLAGS.items()])
    carried = lambda s: F.transform(F.filter(masks, lambda f: s["flags"].bitwiseAND(f["mask"]) != 0), lambda f: F.struct(F.lit("characteristics").alias("group"), F.lit(None).cast("string").alias("level"), f["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    parts.append(F.flatten(F.transform("secs", carried)))
    return rows.select("name", F.inline(F.concat(*parts))).where("label IS NOT NULL")


def quarantine(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executables, and all other blobs with ``reject_reason``; a blob is told by its own bytes, without a join."""
    signed = _bytes(_number(_bytes(E_LFANEW, 4), 0, 4), 4) == F.lit(SIGNATURE)
    empty = F.coalesce(F.length("data"), F.lit(0)) == 0
    reason = F.when(empty, "empty").when(F.substring("data", 1, 2) != F.lit(b"MZ"), "no magic").when(~F.coalesce(signed, F.lit(False)), "no header")
    rows = blobs.withColumn("reject_reason", reason)
    return rows.where("reject_reason IS NULL").drop("reject_reason"), rows.where("reject_reason IS NOT NULL")
