"""Shards of equal numbers of documents that keep linked documents together, by balanced label propagation in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows that one task numbers or places at a time of one key.
CHUNK = 1_024
#: Cells of a queue or shard that one task orders, on average.
QUEUE = 50_000
KEY = ["g1", "g2"]


def quotas(wanted: np.ndarray, free: np.ndarray) -> np.ndarray:
    """How many rows move from shard i to shard j: at most wanted[i, j], and into no shard more than leave it and are free.

    Inflows that are too large are cut in proportion until all fit, then what rounding lost is added where it still fits.
    """
    x = wanted.copy()
    while True:
        into = x.sum(axis=0)
        over = into - x.sum(axis=1) - free
        j = int(np.argmax(over))
        if over[j] <= 0:
            break
        x[:, j] = x[:, j] * int(into[j] - over[j]) // int(into[j])
    more = True
    while more:
        more = False
        for i, j in np.argwhere(wanted > x):
            room = free[j] + x[j].sum() - x[:, j].sum()
            if room > 0:
                x[i, j] += min(room, wanted[i, j] - x[i, j])
                more = True
    return x


def _queued(moves: DataFrame, subs: int) -> DataFrame:
    """moves (with queue, gain, n) and before: the rows of its queue that come first, larger gains before smaller ones.

    A prefix sum in two levels: totals of buckets of a queue, then within each bucket.
    """
    size = F.floor(F.log2(F.abs("gain") + 1)) * F.signum("gain")
    moves = moves.withColumn("bucket", ((64 - size) * subs + F.pmod(F.xxhash64(*KEY), F.lit(subs))).cast("long"))
    totals = moves.groupBy("queue", "bucket").agg(F.sum("n").alias("rows"))
    earlier = W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("queue", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy("queue", "bucket").orderBy(F.desc("gain"), *KEY).rowsBetween(W.unboundedPreceding, -1)
    return moves.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["queue", "bucket"]).withColumn("before", F.col("start") + F.col("inside"))


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table that the JVM holds."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    values = ", ".join(str(row) for row in rows or [(0,) * len(kinds)])
    columns = ", ".join(f"cast(`{n}` AS {k}) AS `{n}`" for n, k in zip(names, kinds))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)}) WHERE {bool(rows)}")


def _applied(cells: DataFrame, queued: DataFrame, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    """cells after the moves of plan: the rows from first to end of a queue go to a shard. A cell may move in part."""
    rows = F.broadcast(_listed(cells.sparkSession, plan, "queue int, to int, first bigint, end bigint"))  # at most one for each two shards
    size = F.least(F.col("before") + F.col("n"), F.col("end")) - F.greatest("before", "first")
    moved = queued.join(rows, "queue").withColumn("m", size).filter("m > 0")
    ends = F.explode(F.array(F.struct(F.col("shard"), (-F.col("m")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("m").alias("n"))))
    changes = moved.select(*KEY, ends.alias("x")).select(*KEY, "x.shard", "x.n")
    return materialize(cells.unionByName(changes).groupBy(*KEY, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))


def _in(values: np.ndarray) -> Column:
    """Of a table of numbers by shard, the one of the row's shard."""
    return F.element_at(F.lit([int(v) for v in values]), F.col("shard") + 1)


def _room(cells: DataFrame, load: np.ndarray, most: np.ndarray, subs: int) -> tuple[DataFrame, np.ndarray]:
    """cells with no shard over its capacity, and the loads: what is too much leaves, the smallest cells first."""
    over, free = np.maximum(load - most, 0), np.maximum(most - load, 0)
    plan, j = [], 0
    for i in np.flatnonzero(over):
        done = 0
        while done < over[i]:
            m = int(min(over[i] - done, free[j]))
            if m:
                plan.append((int(i), j, int(done), int(done + m)))
            done, free[j] = done + m, free[j] - m
            j += not free[j]
    if not plan:
        return cells, load
    leaving = cells.filter(_in(over) > 0).withColumn("queue", F.col("shard")).withColumn("gain", -F.col("n"))
    fitting = _applied(cells, _queued(leaving, subs), plan)
    discard(cells)
    return fitting, _loads(fitting, len(most))[0]


def _gathered(cells: DataFrame, free: np.ndarray, subs: int) -> DataFrame | None:
    """cells with parted groups moved whole to a shard that has room for all their rows, larger groups first; None if none is."""
    groups = cells.groupBy(*KEY).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter((F.col("parts") > 1) & (F.col("n") <= int(free.max())))
    roomy = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), lambda s: F.element_at(F.lit([int(v) for v in free]), s + 1) >= F.col("n"))
    aimed = groups.withColumn("roomy", roomy).withColumn("shard", F.element_at("roomy", F.pmod(F.xxhash64(*KEY), F.size("roomy")).cast("int") + 1))
    queued = _queued(aimed.select(*KEY, "shard", "n", F.col("shard").alias("queue"), F.col("n").alias("gain")), subs)
    fits = queued.filter(F.col("before") + F.col("n") <= _in(free)).select(*KEY, F.col("shard").alias("to"))
    if fits.isEmpty():
        return None
    joined = cells.join(fits, KEY, "left").select(*KEY, F.coalesce("to", "shard").alias("shard"), "n")
    return materialize(joined.groupBy(*KEY, "shard").agg(F.sum("n").alias("n")))


def _loads(cells: DataFrame, shards: int) -> tuple[np.ndarray, int]:
    """Rows in each shard, and the number of cells."""
    found = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).collect()  # a row for each shard
    load = np.zeros(shards, np.int64)
    for r in found:
        load[r["shard"]] = r["n"]
    return load, sum(r["c"] for r in found)


def _asking(cells: DataFrame, open_: Column, least: int) -> DataFrame:
    """The cells that ask to move, with their aim: the group's largest cell, or one of its k largest, if it can fill k shards."""
    group = W.partitionBy(*KEY)  # a group has a cell for each shard at most
    own = F.struct(F.col("n").alias("n"), F.xxhash64("g1", "shard").alias("h"), F.col("shard").alias("to"))
    ranked = cells.withColumn("own", own).withColumn("at", F.row_number().over(group.orderBy(F.desc("own"))))
    ranked = ranked.withColumn("need", F.greatest(F.lit(1), F.floor(F.sum("n").over(group) / least))).withColumn("aims", F.sort_array(F.collect_list(F.when(open_, F.col("own"))).over(group), False))
    ranked = ranked.withColumn("aims", F.slice("aims", 1, F.least(F.col("need"), F.lit(1 << 20)).cast("int"))).filter("size(aims) > 0 AND NOT array_contains(aims, own)")
    return ranked.withColumn("aim", F.element_at("aims", (F.col("at") % F.size("aims")).cast("int") + 1)).filter("aim.n >= n")


def propagated(cells: DataFrame, most: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """cells (g1, g2, shard, n: rows of a group in a shard), a written table, after label propagation, and the shards' loads.

    In a round every group's cells ask to join its largest one (one of its k largest, if it can fill k shards), if this isn't
    smaller; a request's gain is the difference. Quotas by pair of shards keep every load within the limit, and rows with
    larger gains go first. Every second round of three passes over full shards as aims (what is in them stays, but for
    cells smaller than the aim), so that what they can't take meets elsewhere; every third one moves groups that are still
    parted, whole, to shards with room for them. Each move makes links within shards more, so rounds end: when no group is
    parted, when three move nothing, or after rounds of them. The limit is most and a sixteenth more at first, so that
    full shards don't hold everything in place, then most; what is above a limit leaves before, the smallest cells first.
    """
    shards = len(most)
    load, count = _loads(cells, shards)
    subs = 1 + count // (QUEUE * shards)
    for limit in (most + most // 16 + 1, most):
        cells, load = _room(cells, load, limit, subs)
        cells, load = _rounds(cells, load, limit, subs, rounds)
    return cells, load


def _rounds(cells: DataFrame, load: np.ndarray, most: np.ndarray, subs: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    shards, still = len(most), 0
    for turn in range(rounds):
        free, before = most - load, cells
        if turn % 3 == 2:
            cells = _gathered(cells, free, subs) or cells
        else:
            open_ = _in(free > 0) > 0 if turn % 3 else F.lit(True)
            asked = _asking(cells, open_, max(int(most.min()), 1))
            asked = asked.select(*KEY, "shard", "n", (F.col("shard") * shards + F.col("aim.to")).cast("int").alias("queue"), (F.col("aim.n") - F.col("n")).alias("gain"))
            wanted = np.zeros(shards * shards, np.int64)
            for r in asked.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # at most one for each two shards
                wanted[r["queue"]] = r["n"]
            if turn % 3 == 0 and not wanted.any():
                break
            flow = quotas(wanted.reshape(shards, shards), free)
            if flow.any():
                cells = _applied(cells, _queued(asked, subs), [(int(i * shards + j), int(j), 0, int(flow[i, j])) for i, j in np.argwhere(flow)])
        if cells is before:
            still += 1
            if still == 3:
                break
        else:
            still = 0
            discard(before)
            load = _loads(cells, shards)[0]
    return cells, load


def shard(docs: DataFrame, shards: int = 24, rounds: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards of equally many rows (at most one apart), equal texts together as far as that allows.

    Returns (id, size, text_crc32, shard, slot): UTF-8 bytes of the text plus 8, its CRC-32, a shard from 0 and a place
    in it, without gaps. Links are between rows of equal text. As such rows have the same neighbours, propagation works on
    cells, the number of rows that a group has in a shard: labels start from row numbers, then propagated() moves cells.
    Rows without links aren't moved: they fill what is left of each shard. So the shards are even, exactly, at all times.

    A null text is read as an empty one; rows without id, repeated rows and long texts are rows like others; an empty
    table gives an empty result; other columns are dropped. Texts are compared by two hashes of 64 bits. A group larger
    than a shard fills shards and leaves its rest in one. Rows of a large group or of no group are numbered and placed in
    chunks of CHUNK rows; nothing larger than the square of the number of shards reaches the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(narrow)  # from here on a row has its number, whatever is computed again
    base = base.withColumn("chunk", F.expr(f"row div {CHUNK}"))
    start = base.groupBy(*KEY, F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = start.withColumn("all", F.sum("n").over(W.partitionBy(*KEY))).filter(F.col("all") > 1).drop("all")
    rows = base.count()
    most = np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)
    cells, load = propagated(materialize(linked), most, rounds)
    return _placed(base, cells, load, most).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _placed(base: DataFrame, cells: DataFrame, load: np.ndarray, most: np.ndarray) -> DataFrame:
    """Rows with shard and slot: a group's rows, numbered, go to its cells in turn, the others to what is left."""
    # places of cells in their shard, by buckets of groups, and the row numbers that each takes
    buckets = 1 + int(load.sum()) // (QUEUE * len(load))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    prior = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("inside", prior(W.partitionBy("shard", "bucket").orderBy(*KEY))).join(starts, ["shard", "bucket"])
    placed = placed.withColumn("first", prior(W.partitionBy(*KEY).orderBy("shard")))
    ranges = placed.select(F.lit(False).alias("alone"), *KEY, "shard", "first", "n", (F.col("start") + F.col("inside")).alias("slot"))
    left = (most - load).tolist()
    rest = [(True, 0, 0, s, sum(left[:s]), n, int(load[s])) for s, n in enumerate(left) if n]
    ranges = ranges.unionByName(_listed(base.sparkSession, rest, "alone boolean, g1 bigint, g2 bigint, shard int, first bigint, n bigint, slot bigint"))
    span = F.expr(f"sequence(first div {CHUNK}, (first + n - 1) div {CHUNK})")
    ranges = ranges.withColumn("part", F.explode(span))

    # numbers of rows within their group, or among those alone: of chunks, then within each
    chunks = base.groupBy(*KEY, "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.withColumn("all", F.sum("n").over(W.partitionBy(*KEY))).withColumn("alone", F.col("all") == 1)
    keys = [F.when(F.col("alone"), F.lit(0).cast("long")).otherwise(F.col(k)).alias(k) for k in KEY]
    counts = chunks.groupBy("alone", *keys, "chunk").agg(F.sum("n").alias("n"))
    # those alone have a count for each chunk: their prefix sum has a level more
    coarse = F.expr(f"chunk div {CHUNK}")
    high = counts.groupBy("alone", *KEY, coarse.alias("high")).agg(F.sum("n").alias("n"))
    high = high.select("alone", *KEY, "high", prior(W.partitionBy("alone", *KEY).orderBy("high")).alias("above"))
    low = counts.withColumn("high", coarse)
    low = low.withColumn("beside", prior(W.partitionBy("alone", *KEY, "high").orderBy("chunk"))).join(high, ["alone", *KEY, "high"])
    low = low.select("alone", *KEY, "chunk", (F.col("above") + F.col("beside")).alias("begin"))
    which = base.join(chunks.select(*KEY, "chunk", "alone"), [*KEY, "chunk"])
    which = which.select("id", "size", "crc", "row", "chunk", "alone", *keys)
    order = W.partitionBy("alone", *KEY, "chunk").orderBy("row")
    ranked = which.withColumn("at", F.row_number().over(order) - 1).join(low, ["alone", *KEY, "chunk"]).withColumn("rank", F.col("begin") + F.col("at"))
    ranked = ranked.withColumn("part", F.expr(f"rank div {CHUNK}"))
    found = ranked.join(ranges, ["alone", *KEY, "part"]).filter("rank >= first AND rank < first + n")
    return found.withColumn("slot", F.col("slot") + F.col("rank") - F.col("first"))


def cut(sharded: DataFrame) -> DataFrame:
    """(links, cut) of a result of shard(): pairs of rows with equal text (as size and checksum tell), and those in two shards."""
    pairs = lambda n: n * (n - 1) / 2
    cells = sharded.groupBy("size", "text_crc32", "shard").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    groups = cells.groupBy("size", "text_crc32").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    zero = F.lit(0).cast("long")
    return groups.agg(F.coalesce(F.sum("links").cast("long"), zero).alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")).cast("long"), zero).alias("cut"))
