"""Seeded, reproducible sampling: balancing to the median class, samples, stratified split.

Randomness is a hash: every row (and replica) gets ``md5('<seed>:<key>[:<replica>]')`` and
"a sample of n" means "the n rows with the smallest hash" — the same rows on every run, on
any number of executors, and checkable with SQL.

Picking the n smallest hashes per class must not funnel a class through one task (one
class may hold a third of all rows).  Only one *cut value* per class is looked for, and as hashes
are uniform, the n-th smallest of N lies near n/N: one pass counts the rows below a band around
it (eight standard deviations to each side) and ranks those inside, some ``16 * sqrt(n)`` rows.
Where keys repeat so much that the band misses, an exact pass goes by histograms instead:

1. rows per (class, hash prefix), combined map-side; the running sum marks the prefix in which
   the n-th row lies;
2. the same again on a longer prefix, for the rows of that prefix only;
3. the few rows that share the longer prefix (1 in 16**6 of the class) are ranked: the
   n-th one's (hash, key) is the cut.

Every row is then kept or not by comparing its own (hash, key) with its class's cut; rows with
their other columns are read once and never ranked.  A NULL class is a class of its own.  The
table of classes (one row each) is held on the driver up to ``MAX_CLASSES``; with more of them
every step joins it as a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions.lexicons import MIN_SAMPLES_PER_CLASS, RANDOM_SEED, TEST_FRACTION
from tensio.operators.partitioning import materialize

HASH = "_h"
PREFIXES = (3, 6)
#: Samples up to this size are one top-n; larger ones go by a cut value. Both give the same rows.
TOP_N = 10_000
#: Classes whose sizes and cuts are held on the driver and sent to every task.
MAX_CLASSES = 10_000
FEW_CLASSES = 32
#: Half the band, in standard deviations and in rows.
BAND_DEVIATIONS, BAND_ROWS = 8, 64
_HEX = 15


def row_hash(seed: int, key: Column, replica: Column | None = None) -> Column:
    parts = [F.lit(str(seed)), F.lit(":"), key.cast("string")]
    if replica is not None:
        parts += [F.lit(":"), replica.cast("string")]
    return F.md5(F.concat(*parts))


def cut_values(df: DataFrame, group: str, limits: DataFrame, order_tail: Sequence[str]) -> DataFrame:
    """``(_group, _cut)`` per class: the (hash, order_tail) of its last row within the limit.

    ``df`` holds ``_h``; ``limits`` holds ``(_group, _limit)``.  A class with no more rows than its
    limit has no row here (all of it is in), nor has one whose limit is 0.
    """
    rows = df.select(F.col(group).alias("_group"), HASH, *order_tail)
    left = limits.where("_limit > 0")
    for digits in PREFIXES:
        rows = rows.withColumn("_prefix", F.substring(HASH, 1, digits))
        counts = rows.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_prefix")) - F.col("_n")
        near = counts.withColumn("_before", before).join(left.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g")))
        # The n-th row lies in the one prefix that starts before it and does not end before it.
        near = near.where((F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_n") >= F.col("_limit")))
        edge = near.select(F.col("_g"), F.col("_prefix").alias("_p"), (F.col("_limit") - F.col("_before")).alias("_room"))
        rows = rows.join(edge, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_prefix") == F.col("_p"))).drop("_g", "_p", "_prefix")
        left = edge.select(F.col("_g").alias("_group"), F.col("_room").alias("_limit"))
        if digits != PREFIXES[-1]:
            rows = rows.drop("_room")
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(HASH, *order_tail))
    last = rows.withColumn("_rank", rank).where("_rank = _room")
    return last.select("_group", F.struct(HASH, *order_tail).alias("_cut"))


def flag_by_histogram(df: DataFrame, group: str, limits: DataFrame, order_tail: Sequence[str], flag: str) -> DataFrame:
    """As ``flag_smallest`` for any number of classes: ``limits`` is a table ``(_group, _limit)``."""
    cuts = materialize(cut_values(df, group, limits, order_tail))
    table = limits.join(cuts.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g")), "left").drop("_g")
    inside = F.coalesce(F.struct(HASH, *order_tail) <= F.col("_cut"), F.col("_limit") > 0)
    return df.join(table, F.col(group).eqNullSafe(F.col("_group"))).withColumn(flag, inside).drop("_group", "_limit", "_cut")


def hash_band(rows: int, limit: int) -> tuple[str, str]:
    """Between which hashes the ``limit``-th smallest of ``rows`` lies, but for a chance of 1e-14."""
    place = limit / rows
    half = BAND_DEVIATIONS * math.sqrt(place * (1 - place) / rows) + BAND_ROWS / rows
    low, high = place - half, place + half
    return ("" if low <= 0 else f"{int(low * 16**_HEX):0{_HEX}x}"), ("g" if high >= 1 else f"{int(high * 16**_HEX):0{_HEX}x}")


def _class_frame(df: DataFrame, group: str, rows: list[tuple], fields: list[TY.StructField]) -> DataFrame:
    """A table of classes (at most ``MAX_CLASSES`` rows, sent to every task) keyed by ``_group``."""
    kind = TY.StructField("_group", df.schema[group].dataType)
    return F.broadcast(df.sparkSession.createDataFrame(rows, TY.StructType([kind, *fields])))


def _with_class_values(df: DataFrame, group: str, rows: list[tuple], fields: list[TY.StructField]) -> DataFrame:
    """Add each row's values of its class (NULL for a class that ``rows`` lacks): a few classes of plain
    type are compared in the plan, more of them come from a small broadcast table."""
    plain = isinstance(df.schema[group].dataType, (TY.IntegralType, TY.StringType, TY.BooleanType))
    if len(rows) > FEW_CLASSES or not plain:
        table = _class_frame(df, group, rows, fields)
        return df.join(table, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    columns = {}
    for i, f in enumerate(fields, start=1):
        value = F.lit(None).cast(f.dataType)
        for r in reversed(rows):
            value = F.when(F.col(group).eqNullSafe(F.lit(r[0])), F.lit(r[i]).cast(f.dataType)).otherwise(value)
        columns[f.name] = value
    return df.withColumns(columns)


def _cuts(df: DataFrame, group: str, wanted: list[tuple], order_tail: Sequence[str]) -> dict[int, tuple]:
    """Cut of each class of ``wanted`` (``(value, rows, limit)``, 0 < limit < rows), by its place there."""
    bands = [(value, i, limit, *hash_band(rows, limit)) for i, (value, rows, limit) in enumerate(wanted)]
    if not bands:
        return {}
    fields = [TY.StructField("_no", TY.IntegerType()), TY.StructField("_limit", TY.LongType()), TY.StructField("_low", TY.StringType()), TY.StructField("_high", TY.StringType())]
    near = _with_class_values(df.select(F.col(group).alias("_own"), HASH, *order_tail), "_own", bands, fields).where(F.col("_no").isNotNull())
    # Rows below the band (a NULL key is the smallest) become one count per class and task, rows in it stay apart (equal ones together).
    place = F.when(F.col(HASH) >= F.col("_low"), F.struct(HASH, *order_tail))
    counted = near.where((F.col(HASH) < F.col("_high")) | F.col(HASH).isNull()).groupBy("_no", "_limit", place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_no").orderBy(F.asc_nulls_first("_place")))
    last = counted.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_limit")) & (F.col("_upto") - F.col("_n") < F.col("_limit")))
    found = {r["_no"]: tuple(r["_place"]) for r in last.select("_no", "_place").collect() if r["_place"] is not None}  # one row per class
    missed = [i for i in range(len(wanted)) if i not in found]
    if missed:
        again = _class_frame(df, group, [(wanted[i][0], i, wanted[i][2]) for i in missed], fields[:2])
        rows = df.join(again.select(F.col("_group").alias("_class"), "_no"), F.col(group).eqNullSafe(F.col("_class"))).select("_no", HASH, *order_tail)
        exact = cut_values(rows, "_no", again.select(F.col("_no").alias("_group"), "_limit"), order_tail)
        found |= {r["_group"]: tuple(r["_cut"]) for r in exact.collect()}
    return found


def flag_smallest(df: DataFrame, group: str, sizes: list[tuple], order_tail: Sequence[str], flag: str) -> DataFrame:
    """Add boolean ``flag``: is the row among the smallest ``_h`` of its class, up to its limit.

    ``df`` must hold ``_h`` (hex string); ``sizes`` has ``(value, rows, limit)`` for every class.  Ties
    on ``_h`` are broken by ``order_tail``.
    """
    wanted = [s for s in sizes if 0 < s[2] < s[1]]
    cuts = _cuts(df, group, wanted, order_tail)
    rows = [(value, True, *[None] * (1 + len(order_tail))) for value, n, limit in sizes if limit >= n and limit > 0]
    rows += [(value, False, *cuts[i]) for i, (value, _, _) in enumerate(wanted)]
    names = [f"_cut{i}" for i in range(1 + len(order_tail))]
    kinds = [TY.StringType(), *[df.schema[c].dataType for c in order_tail]]
    fields = [TY.StructField("_whole", TY.BooleanType()), *[TY.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]
    inside = F.when(F.col("_whole"), True).when(F.col("_whole").isNotNull(), F.struct(HASH, *order_tail) <= F.struct(*names))
    out = _with_class_values(df, group, rows, fields)
    return out.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_whole", *names)


def class_sizes(df: DataFrame, label: str) -> list[tuple] | None:
    """``(value, rows)`` of every class, or None if they are more than ``MAX_CLASSES``."""
    rows = class_counts(df, label).limit(MAX_CLASSES + 1).collect()
    return None if len(rows) > MAX_CLASSES else [tuple(r) for r in rows]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


REPLICA_CHUNK = 4096


def replicate(df: DataFrame, copies: Column, max_copies: int, spread_by: Sequence[str], out: str = "replica") -> DataFrame:
    """Each row ``copies`` times, numbered ``1..copies`` in column ``out``.

    A row copied a few times is exploded in place.  When some row must be copied more than
    ``REPLICA_CHUNK`` times (a tiny class balanced up to a large target), the copies are
    produced in chunks: chunk ids are exploded first and spread over the cluster by a
    shuffle, and each task then expands only its chunks, so no single task generates all
    copies of a row.
    """
    if max_copies <= REPLICA_CHUNK:
        return df.withColumn(out, F.explode(F.sequence(F.lit(1), copies)))
    chunk = F.lit(REPLICA_CHUNK)
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((copies - 1) / chunk).cast("int"))))
    chunks = chunks.repartition(*[F.col(c) for c in spread_by], F.col("_chunk"))
    first = F.col("_chunk") * chunk + 1
    last = F.least((F.col("_chunk") + 1) * chunk, copies)
    return chunks.withColumn(out, F.explode(F.sequence(first, last))).drop("_chunk")


def balance_target(counts: DataFrame, min_per_class: int = MIN_SAMPLES_PER_CLASS) -> DataFrame:
    """One row: ``max(floor(median(class sizes)), min_per_class)`` over present classes."""
    return counts.agg(F.greatest(F.floor(F.median("n")), F.lit(min_per_class)).cast("long").alias("target"))


def balance_classes(
    df: DataFrame,
    label: str,
    key: str,
    seed: int = RANDOM_SEED,
    min_per_class: int = MIN_SAMPLES_PER_CLASS,
) -> DataFrame:
    """Every present class resized to the target: larger ones sampled down, smaller ones
    copied ``ceil(target / n)`` times and then sampled down; absent classes stay absent.  A NULL
    class counts and is resized like any other.

    Output: the input columns plus ``replica`` (1-based copy number).
    """
    sizes = class_sizes(df, label)
    if sizes is None:
        return _balance_many(df, label, key, seed, min_per_class)
    if not sizes:
        return df.withColumn("replica", F.lit(1)).limit(0)
    target = median_target([n for _, n in sizes], min_per_class)
    return _resize(df, label, key, seed, [(value, n, target) for value, n in sizes])


def median_target(sizes: Sequence[int], min_per_class: int = MIN_SAMPLES_PER_CLASS) -> int:
    """``balance_target`` on a list."""
    ordered, middle = sorted(sizes), len(sizes) // 2
    median = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) // 2
    return max(median, min_per_class)


def _resize(df: DataFrame, label: str, key: str, seed: int, plan: list[tuple]) -> DataFrame:
    """Every class of ``plan`` (``(value, rows, target)``) copied and sampled down to its target."""
    copies = [-(-target // n) for _, n, target in plan]
    rows = _with_class_values(df, label, [(p[0], c) for p, c in zip(plan, copies, strict=True)], [TY.StructField("_copies", TY.IntegerType())])
    rows = replicate(rows, F.col("_copies"), max(copies), spread_by=[key]).drop("_copies")
    rows = rows.withColumn(HASH, row_hash(seed, F.col(key), F.col("replica")))
    wanted = [(value, n * c, target) for (value, n, target), c in zip(plan, copies, strict=True)]
    return flag_smallest(rows, label, wanted, [key, "replica"], "_pick").filter("_pick").drop("_pick", HASH)


def _by_group(df: DataFrame, group: str, label: str) -> tuple[DataFrame, dict]:
    """``df`` with ``_class`` (group and label), and the class sizes of each group."""
    rows = df.withColumn("_class", F.struct(F.col(group).alias("g"), F.col(label).alias("y")))
    sizes = class_sizes(rows, "_class")
    if sizes is None:
        raise ValueError(f"more than {MAX_CLASSES} classes over all groups")
    groups: dict = {}
    for value, n in sizes:
        groups.setdefault(value["g"], []).append((value["y"], n))
    return rows, groups


def balance_groups(df: DataFrame, group: str, label: str, key: str, seed: int = RANDOM_SEED, min_per_class: int = MIN_SAMPLES_PER_CLASS) -> DataFrame:
    """``balance_classes`` within every value of ``group``, all groups by the same passes."""
    rows, groups = _by_group(df, group, label)
    plan = [((g, y), n, median_target([m for _, m in sizes], min_per_class)) for g, sizes in groups.items() for y, n in sizes]
    if not plan:
        return df.withColumn("replica", F.lit(1)).limit(0)
    return _resize(rows, "_class", key, seed, plan).drop("_class")


def split_groups(df: DataFrame, group: str, label: str, key: str, test_fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED, out: str = "fold") -> DataFrame:
    """``stratified_split`` within every value of ``group``, all groups by the same passes."""
    rows, groups = _by_group(df, group, label)
    sizes = [((g, y), n, test) for g, classes in groups.items() for y, n, test in test_rows(classes, test_fraction)]
    flagged = flag_smallest(rows.withColumn(HASH, row_hash(seed, F.col(key))), "_class", sizes, [key], "_test")
    return flagged.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test", HASH, "_class")


def _balance_many(df: DataFrame, label: str, key: str, seed: int, min_per_class: int) -> DataFrame:
    """``balance_classes`` with the classes as a table."""
    counts = materialize(class_counts(df, label))
    smallest = counts.agg(F.min("n")).first()[0]
    if smallest is None:  # nothing to balance
        return df.withColumn("replica", F.lit(1)).limit(0)
    target = balance_target(counts, min_per_class).first()["target"]
    plan = counts.select(F.col(label).alias("_class"), F.ceil(F.lit(target) / F.col("n")).cast("int").alias("_copies"))
    rows = df.join(plan, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")
    max_copies = math.ceil(target / smallest)
    rows = replicate(rows, F.col("_copies"), max_copies, spread_by=[key]).drop("_copies")
    rows = rows.withColumn(HASH, row_hash(seed, F.col(key), F.col("replica")))
    limits = counts.select(F.col(label).alias("_group"), F.lit(target).cast("long").alias("_limit"))
    return flag_by_histogram(rows, label, limits, [key, "replica"], "_pick").filter("_pick").drop("_pick", HASH)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = RANDOM_SEED) -> DataFrame:
    """``n`` rows without replacement (all rows when there are fewer)."""
    rows = df.withColumn(HASH, row_hash(seed, F.col(key)))
    if n <= TOP_N:
        return rows.orderBy(HASH, key).limit(n).drop(HASH)
    return flag_smallest(rows.withColumn("_all", F.lit(0)), "_all", [(0, df.count(), n)], [key], "_pick").filter("_pick").drop("_pick", "_all", HASH)


def split_sizes(counts: DataFrame, label: str, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """``(_group, _limit)``: test rows per class.

    ``n_test = ceil(f·N)``, ``n_train = N - n_test``; train rows are allotted to classes in
    proportion, rounding down, and the remaining ones go to the classes with the largest
    fractional parts (ties: lower label first, NULL before all).  Test rows per class are the
    rest.  Works on the table of classes, one row per class.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_train = total - math.ceil(test_fraction * total)
    share = F.col("n") / F.lit(float(max(total, 1))) * F.lit(float(n_train))
    sized = counts.select(F.col(label).alias("_group"), "n", share.alias("_share"), F.floor(share).alias("_train"))
    need = n_train - (sized.agg(F.sum("_train")).first()[0] or 0)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_train")), F.asc_nulls_first("_group")))
    more = (rank <= F.lit(need)).cast("long")
    return sized.select("_group", (F.col("n") - F.col("_train") - more).cast("long").alias("_limit"))


def test_rows(sizes: list[tuple], test_fraction: float = TEST_FRACTION) -> list[tuple]:
    """``split_sizes`` on a list of ``(value, rows)``: ``(value, rows, test rows)``."""
    total = sum(n for _, n in sizes)
    n_train = total - math.ceil(test_fraction * total)
    shares = [n / float(max(total, 1)) * float(n_train) for _, n in sizes]
    train = [math.floor(x) for x in shares]
    order = sorted(range(len(sizes)), key=lambda i: (-(shares[i] - train[i]), sizes[i][0] is not None, sizes[i][0]))
    for i in order[: n_train - sum(train)]:
        train[i] += 1
    return [(value, n, n - train[i]) for i, (value, n) in enumerate(sizes)]


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_fraction: float = TEST_FRACTION,
    seed: int = RANDOM_SEED,
    out: str = "fold",
) -> DataFrame:
    """Add ``fold`` = ``'test'`` / ``'train'``; every row gets one.  A NULL label is a class of
    its own."""
    rows = df.withColumn(HASH, row_hash(seed, F.col(key)))
    sizes = class_sizes(df, label)
    if sizes is None:
        limits = materialize(split_sizes(materialize(class_counts(df, label)), label, test_fraction))
        flagged = flag_by_histogram(rows, label, limits, [key], "_test")
    else:
        flagged = flag_smallest(rows, label, test_rows(sizes, test_fraction), [key], "_test")
    return flagged.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test", HASH)
