"""Training, validation and test splits: random, by class ratio, by time. Splits are 0 (tr), 1 (vl), 2 (ts)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from bytebasin.operators.ranking import global_rank, running_sums, seeded

NAMES = ("tr", "vl", "ts")


def largest_remainder(n: int, shares: Sequence[float]) -> list[int]:
    """Whole counts for shares of ``n``, the rest going by largest remainder and then to the earlier split.

    Shares lie in [0, 1] and sum to 1 at most; what they leave over is a remainder that takes part and is dropped.
    """
    if any(not 0 <= s <= 1 for s in shares) or sum(shares) > 1 + 1e-12:
        raise ValueError("shares must lie in [0, 1] and sum to 1 at most")
    exact = [s * n for s in [*shares, max(0.0, 1 - sum(shares))]]
    counts = [math.floor(x + 1e-9) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (-(exact[i] - counts[i]), i))
    for i in order[: n - sum(counts)]:
        counts[i] += 1
    return counts[: len(shares)]


def _by_rank(ranked: DataFrame, counts: Sequence[int]) -> DataFrame:
    split, upto = F.lit(None).cast("int"), sum(counts)
    for i in reversed(range(len(counts))):
        split = F.when(F.col("rank") < upto, i).otherwise(split)
        upto -= counts[i]
    return ranked.withColumn("split", split).where("split IS NOT NULL")


def random_split(df: DataFrame, shares: Sequence[float], seed: int | None = 0, key: str = "idx") -> DataFrame:
    """Rows with ``split``, by seeded order, or by ``key`` as they are where the seed is None."""
    order = [seeded(F.col(key), seed), F.col(key)] if seed is not None else [F.col(key)]
    return _by_rank(global_rank(df, *order), largest_remainder(df.count(), shares)).drop("rank")


def temporal_split(df: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The oldest rows to training, then validation, then test, in exact counts; ties in time go by ``idx``."""
    return _by_rank(global_rank(df, "ts", "idx"), largest_remainder(df.count(), shares)).drop("rank")


def desired_ratios(available: dict, ratios: dict | None = None) -> dict:
    """Share of each class: the one it has among all rows, or ``ratios`` as weights, which must name every class and
    neither be negative nor sum to nothing."""
    if ratios is None:
        total = sum(available.values())
        return {c: n / total for c, n in available.items()} if total else {c: 1 / len(available) for c in available}
    if set(ratios) != set(available) or any(r < 0 for r in ratios.values()) or sum(ratios.values()) <= 0:
        raise ValueError("ratios must be weights of all classes, not negative, and more than 0 together")
    total = sum(ratios.values())
    return {c: r / total for c, r in ratios.items()}


def _in_order(classes) -> list:
    """Classes by value; rows without a label are a class of their own, the last."""
    return sorted(classes, key=lambda c: (c is None, 0 if c is None else c))


def class_quotas(available: dict, counts: Sequence[int], ratios: dict | None = None) -> list[tuple[int | None, int, int, int]]:
    """(class, split, from, to) places in each class's order, splits drawing in turn from what is left.

    A split takes of each class the whole part of its share or what is there; units then still wanting go one by one to
    the class with the largest remainder that has rows left, remainders standing as they were. A shortage is let be.
    ``ratios`` are weights, as ``desired_ratios`` takes them; None is the class of rows without a label.
    """
    if not available:
        return []
    wanted, left, at, out = desired_ratios(available, ratios), dict(available), dict.fromkeys(available, 0), []
    for split, n in enumerate(counts):
        exact = {c: wanted[c] * n for c in available}
        take = {c: min(math.floor(exact[c] + 1e-9), left[c]) for c in available}
        remainder = {c: exact[c] - math.floor(exact[c] + 1e-9) for c in available}
        # the class of largest remainder keeps it, so it takes all that it has before the next one does
        missing = n - sum(take.values())
        for c in sorted(_in_order(available), key=lambda c: -remainder[c]):
            more = min(missing, left[c] - take[c])
            take[c] += more
            missing -= more
        for c in available:
            out.append((c, split, at[c], at[c] + take[c]))
            at[c] += take[c]
            left[c] -= take[c]
    return out


def stratified_split(df: DataFrame, shares: Sequence[float], ratios: dict | None = None, seed: int = 0, key: str = "idx") -> DataFrame:
    """Rows with ``split`` such that every split has the class ratios given, or those of all rows.

    Rows are ranked once, by class and seeded order; the driver holds a count for each class and split. Rows without a
    label are a class of their own.
    """
    available = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    quotas = class_quotas(available, largest_remainder(sum(available.values()), shares), ratios)
    begins = dict(zip(_in_order(available), accumulate([0, *[available[c] for c in _in_order(available)]])))
    rows = [(c, split, begins[c] + lo, begins[c] + hi) for c, split, lo, hi in quotas if hi > lo]
    plan = df.sparkSession.createDataFrame(rows, df.select(F.col("label").alias("__class")).schema.add("split", IntegerType()).add("__lo", LongType()).add("__hi", LongType()))
    ranked = global_rank(df, F.col("label").asc_nulls_last(), seeded(F.col(key), seed), F.col(key), into="__rank")
    met = F.col("label").eqNullSafe(F.col("__class")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    return ranked.join(F.broadcast(plan), met).drop("__rank", "__class", "__lo", "__hi")  # a row for each class and split


def class_prefixes(ranked: DataFrame, at: Sequence[int]) -> dict[int, dict]:
    """How many rows of each class come before each given rank: a number for each rank and class, on the driver.

    A row finds its place among the ranks by a binary search in the JVM; counts are summed up before the shuffle.
    """
    from pyspark.ml.feature import Bucketizer

    edges = sorted(set(at))
    placed = ranked.select("label", F.col("rank").cast("double").alias("rank"))
    cells = Bucketizer(splits=[-math.inf, *map(float, edges), math.inf], inputCol="rank", outputCol="cell").transform(placed)
    found = cells.groupBy(F.col("cell").cast("int").alias("cell"), "label").agg(F.count("*").alias("n")).collect()
    classes = _in_order({r["label"] for r in found})
    in_cell = {(r["cell"], r["label"]): r["n"] for r in found}
    upto, out = dict.fromkeys(classes, 0), {}
    for i, e in enumerate(edges):
        for c in classes:
            upto[c] += in_cell.get((i, c), 0)
        out[e] = dict(upto)
    return out


def prefix_counts(ranked: DataFrame, at: Sequence[int]) -> DataFrame:
    """(rank, n, pos): how many rows, and how many of label 1, come before each given rank. A row for each rank."""
    found = class_prefixes(ranked, at)
    rows = [(e, sum(c.values()), c.get(1, 0)) for e, c in found.items()]
    return ranked.sparkSession.createDataFrame(rows, "rank long, n long, pos long")


def _shares(counts: Column) -> Column:
    """Counts by class as shares; alike where there are none."""
    total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(counts)))


def _apart(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def _distances(shares: list[Column], target: list[float] | None) -> list[Column]:
    """Differences by class: of every split from the target, or of every pair of splits where there is none."""
    if target is not None:
        goal = F.array(*map(F.lit, target))
        return [_apart(s, goal) for s in shares]
    return [_apart(shares[i], shares[j]) for i in range(len(shares)) for j in range(i)]


def balanced_cuts(ranked: DataFrame, n: int, shares: Sequence[float], ratios: dict | None = None, max_shift: int = 0, step: int = 1, penalty: float = 0.05, tolerance: float | None = None) -> DataFrame:
    """The best pair of cuts (p, q) around the strict ones, as one row (p, q, end, score, ok).

    Candidates rise by ``step`` from ``max_shift`` below the strict cuts to as much above them, within the rows; the test
    split keeps its length where there are rows for it. A candidate's score is the sum over classes of the distances of
    its splits' shares from ``ratios`` (weights), or of the splits from each other where none are given, plus ``penalty``
    for each row by which a split's size is off. Candidates within ``tolerance`` (the greatest such distance) come
    first, then the least score, then the strict cuts, then the smaller ones. An empty split has all classes alike.

    Rows are counted at the candidates alone; how many there are depends on the parameters, not on the rows. Their grid
    is scored as a table.
    """
    if max_shift < 0 or step <= 0:
        raise ValueError("max_shift must not be negative and step must be positive")
    spark = ranked.sparkSession
    tr, vl, ts = largest_remainder(n, shares)
    p0, q0 = tr, tr + vl
    p_lo, q_lo = max(0, p0 - max_shift), max(0, p0 - max_shift, q0 - max_shift)
    ps, qs = range(p_lo, min(n, p0 + max_shift) + 1, step), range(q_lo, min(n, q0 + max_shift) + 1, step)
    # a q that lies below p is taken at p, as the search for q begins there
    starts = sorted({q for p in ps for q in [max(p, q_lo)]})
    firsts, seconds = sorted({*ps, p0}), sorted({*qs, *starts, q0, *(q for s in starts for q in range(s, min(n, q0 + max_shift) + 1, step))})
    ends = {q: q + min(ts, n - q) for q in seconds}
    upto = class_prefixes(ranked, [0, n, *firsts, *seconds, *ends.values()])
    classes = _in_order(upto[n])
    available = {c: upto[n][c] for c in classes}
    target = None if ratios is None else [desired_ratios(available, ratios)[c] for c in classes]

    def before(rank: int) -> list[int]:
        return [upto[rank][c] for c in classes]

    left = spark.createDataFrame([(p, before(p)) for p in firsts], "p long, cp array<long>")
    right = spark.createDataFrame([(q, ends[q], before(q), before(ends[q])) for q in seconds], "q long, end long, cq array<long>, ce array<long>")
    span = F.sequence(F.greatest(F.col("p"), F.lit(q_lo)), F.lit(min(n, q0 + max_shift)), F.lit(step))
    grid = left.where(F.col("p").isin(list(ps))).where(F.greatest(F.col("p"), F.lit(q_lo)) <= min(n, q0 + max_shift))
    pairs = grid.select("p", F.explode(span).alias("q")).union(spark.createDataFrame([(p0, q0)], "p long, q long")).distinct()
    found = pairs.join(left, "p").join(right, "q")

    def minus(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: x - y)

    dists = _distances([_shares(F.col("cp")), _shares(minus("cq", "cp")), _shares(minus("ce", "cq"))], target)
    size = F.abs(F.col("p") - tr) + F.abs(F.col("q") - F.col("p") - vl) + F.abs(F.col("end") - F.col("q") - ts)
    score = F.round(sum(map(_summed, dists), F.lit(0.0)) + penalty * size, 9)
    ok = reduce(lambda a, b: a & b, [F.array_max(d) <= tolerance for d in dists]) if tolerance is not None else F.lit(False)
    moved = (F.col("p") != p0) | (F.col("q") != q0)
    best = found.agg(F.min(F.struct((~ok).alias("off"), score.alias("score"), moved.alias("moved"), "p", "q", "end")).alias("b"))
    return best.select("b.p", "b.q", "b.end", "b.score", (~F.col("b.off")).alias("ok"))


def trimmed_cuts(ranked: DataFrame, n: int, cuts: tuple[int, int, int], tolerance: float, step: int, ratios: dict | None = None) -> tuple[int, int, int, int] | None:
    """(begin, p, q end, end): the smallest trims, by ``step``, of the training split's beginning and of the others' ends
    that bring each split's shares within ``tolerance`` of ``ratios`` (weights); None where they can't be.

    Without ratios a split by itself is never off, so nothing is trimmed, and the splits have to be near each other as
    they are. Only counts at multiples of the step are summed up, a row for each, in ranges.
    """
    p, q, end = cuts
    upto = class_prefixes(ranked, [0, p, q, end, n])
    classes = _in_order(upto[n])
    available = {c: upto[n][c] for c in classes}
    target = None if ratios is None else [desired_ratios(available, ratios)[c] for c in classes]
    trims = [0, 0, 0]
    if target is not None:
        trims = [_least_trim(ranked, lo, hi, front, step, classes, target, tolerance) for lo, hi, front in ((0, p, True), (p, q, False), (q, end, False))]
    kept = [(trims[0], p), (p, q - trims[1]), (q, end - trims[2])]
    at = class_prefixes(ranked, [x for k in kept for x in k])
    dists = [[at[b].get(c, 0) - at[a].get(c, 0) for c in classes] for a, b in kept]
    dists = [[x / sum(d) if sum(d) else 1 / len(d) for x in d] for d in dists]
    pairs = [(d, target) for d in dists] if target is not None else [(dists[i], dists[j]) for i in range(3) for j in range(i)]
    if all(max(abs(x - y) for x, y in zip(a, b)) <= tolerance for a, b in pairs):
        return trims[0], p, q - trims[1], end - trims[2]
    return None


def _least_trim(ranked: DataFrame, lo: int, hi: int, front: bool, step: int, classes: list, target: list[float], tolerance: float) -> int:
    """The smallest multiple of ``step`` by which [lo, hi) is trimmed to come within tolerance; 0 where none does."""
    inside = ranked.where((F.col("rank") >= lo) & (F.col("rank") < hi))
    distance = F.col("rank") - lo if front else hi - 1 - F.col("rank")
    columns = [f"c{i}" for i in range(len(classes))]
    counts = [F.count_if(F.col("label").eqNullSafe(F.lit(c))).alias(name) for c, name in zip(classes, columns)]
    cells = inside.groupBy(F.floor(distance / step).alias("cell")).agg(*counts)
    # a row for trimming nothing, and one for trimming each cell and all before it
    nothing = ranked.sparkSession.createDataFrame([(-1, *[0] * len(columns))], "cell long" + "".join(f", {c} long" for c in columns))
    summed = running_sums(cells.unionByName(nothing), ["cell"], *columns)
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in columns])
    trim = (F.col("cell") + 1) * step
    rest = F.array(*[F.col(f"all_{c}") - F.col(f"sum_{c}") for c in columns])
    near = F.array_max(_apart(_shares(rest), F.array(*map(F.lit, target)))) <= tolerance
    found = summed.crossJoin(F.broadcast(total)).where(near & (trim <= hi - lo)).agg(F.min(trim).alias("trim")).first()["trim"]
    return int(found or 0)


def balanced_split(df: DataFrame, shares: Sequence[float], ratios: dict | None = None, max_shift: int = 0, step: int = 1, penalty: float = 0.05, tolerance: float | None = None) -> DataFrame:
    """A temporal split whose two cuts move a little to keep class shares alike; see ``balanced_cuts``.

    Where a tolerance is given and no cuts keep it, splits are trimmed to keep it (``trimmed_cuts``), or stay as they are
    where that can't be either. Any number of classes; without ratios splits are held against each other.
    """
    n = df.count()
    if not n:
        return df.withColumn("split", F.lit(None).cast("int"))
    ranked = global_rank(df, "ts", "idx")
    best = balanced_cuts(ranked, n, shares, ratios, max_shift, step, penalty, tolerance).first()
    begin, p, q_end, q, end = 0, best["p"], best["q"], best["q"], best["end"]
    if tolerance is not None and not best["ok"] and (cut := trimmed_cuts(ranked, n, (p, q, end), tolerance, step, ratios)):
        begin, p, q_end, end = cut
    rank = F.col("rank")
    split = F.when((rank >= begin) & (rank < p), 0).when((rank >= p) & (rank < q_end), 1).when((rank >= q) & (rank < end), 2)
    return ranked.withColumn("split", split.cast("int")).where("split IS NOT NULL").drop("rank")


def removed_report(n: int, split: DataFrame, shares: Sequence[float], reason: str) -> DataFrame:
    """(n, expected_removed, actual_removed, reason) of a split."""
    expected = n - sum(largest_remainder(n, shares))
    return split.agg((F.lit(n) - F.count("*")).alias("actual_removed")).select(F.lit(n).cast("long").alias("n"), F.lit(expected).cast("long").alias("expected_removed"), "actual_removed", F.lit(reason).alias("reason"))


def write_splits(split: DataFrame, folder: str) -> None:
    """Splits as Parquet by split and shard; a folder that is there is refused."""
    named = split.withColumn("split", F.element_at(F.array(*map(F.lit, NAMES)), F.col("split") + 1))
    named.write.mode("error").partitionBy("split", "shard").parquet(folder)


def align(df: DataFrame, features: DataFrame, key: str = "idx") -> DataFrame:
    """Rows with their features; an error for a row without any."""
    joined = df.join(features.withColumn("__there", F.lit(True)), key, "left")
    check = F.when(F.col("__there").isNull(), F.raise_error(F.lit("a row has no feature")).cast("boolean")).otherwise(F.lit(True))
    return joined.where(check).drop("__there")


def segment_counts(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of every class between two ranks of the time order."""
    ranked = global_rank(df, "ts", "idx").where((F.col("rank") >= lo) & (F.col("rank") < hi))
    return ranked.groupBy("label").agg(F.count("*").alias("n"))


