"""N-gram Jaccard join by universe partition: segments of each set, one-deletion neighbourhoods, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, checked, discard, fewer, materialize, slices, small_files, text_bytes
from .components import components
from .textops import LOWER, inside, mix, owner, windows, words

#: Keys in a shard (one task's unit), keys that a task gathers before it sends them, share of segments with deletions.
SHARD_KEYS, FLUSH, RESERVE = 1 << 17, 1 << 17, 0.08
#: A key with more sets is costly: its sets may give it up as far as their slack goes.
COSTLY = 8
#: Sets, and shingles of sets, of one key or family that make a block: a task compares two blocks at a time.
WIDE, WIDE_SHINGLES = 2_048, 1 << 21
#: Pairs of one document that one task verifies.
PAIRS = 256
DELETED, UPPER, DOUBLE = 1, 2, 4
MOST = (1 << 64) - 1


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: (text, hash), sorted by both. Fewer words are one shingle."""
    hashes, bounds = words([t.translate(LOWER) for t in texts])
    count = np.diff(bounds)
    grams = windows(hashes, n)
    at = np.flatnonzero(inside(bounds, n, len(grams))) if len(grams) else np.empty(0, np.int64)
    docs, values = [owner(bounds)[at]], [grams[at]]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            docs.append(short)
            values.append(mix(windows(hashes, m)[bounds[short]] ^ np.uint64(m)))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def digests(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit digest of each text's set."""
    size = np.bincount(doc, minlength=n).astype(np.int64)
    a = mix(per_text(mix(value), doc, n) + size.astype(np.uint64))
    return size, a, mix(per_text(mix(value ^ np.uint64(0x5851F42D4C957F2D)), doc, n) ^ a)


def sketches(doc: np.ndarray, value: np.ndarray, n: int) -> list[bytes]:
    """Parity sketch of each set: bit h mod B flipped for each hash h, B a power of two of 2 to 4 bits a shingle.

    Each shingle that only one of two sets has flips one bit, so two sketches (the longer one folded) never differ in
    more bits than their sets do in shingles.
    """
    edge = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        bits = max(64, 1 << (2 * (hi - lo) - 1).bit_length()) if hi > lo else 64
        at = (mix(value[lo:hi] ^ np.uint64(0x94D049BB133111EB)) & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


class Sketches:
    """Sketches of rows, by length, with the next longer ones folded to it."""

    def __init__(self, rows: list[bytes]):
        self.words = np.array([len(x) // 8 for x in rows])
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words).tolist():
            own, longer = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            x = np.frombuffer(b"".join(rows[i] for i in own), np.uint64).reshape(-1, w)
            if len(longer):
                y = np.frombuffer(b"".join(rows[i] for i in longer), np.uint64).reshape(-1, 2, w)
                x = np.concatenate([x, y[:, 0] ^ y[:, 1]])
            place = np.full(len(rows), -1)
            place[np.concatenate([own, longer])] = np.arange(len(x))
            self.levels[w] = x, place

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least number of shingles that the sets of rows i and j differ in; sets of linked sizes only."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.words[i], self.words[j])
        for w, (x, place) in self.levels.items():
            use = np.flatnonzero(least == w)
            step = max(1, (1 << 19) // w)
            for at in range(0, len(use), step):
                k = use[at : at + step]
                a, b = place[i[k]], place[j[k]]
                ok = (a >= 0) & (b >= 0)
                out[k[ok]] = np.bitwise_count(x[a[ok]] ^ x[b[ok]]).sum(axis=1)
        return out


def within(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of sizes a and b can link, and in how many shingles they then differ at most."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b), (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Bands of set sizes whose linked sets lie in the same or the next one, and the segments of each pair of bands.

    Sets of sizes a and b linked at percent per cent differ in at most (a + b)(100 - percent)/(100 + percent) shingles.
    Pair j holds sets of band j (lower) and band j + 1 (upper). Of its m segments the first r carry deletions, and the
    weight m + r exceeds the most differences plus twice the slack that each set may give up.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low += [self.low[-1] * 100 // percent + 1]
        self.low += [self.low[-1] * 100 // percent + 1]
        m, r, slack = [], [], []
        for j in range(len(self.low) - 2):
            top = self.low[j + 1] - 1
            most = (top + min(top * 100 // percent, self.low[j + 2] - 1)) * (100 - percent) // (100 + percent)
            s = -(-(most + 1) * RESERVE // 2) if most else 0
            m.append(most + 1)
            r.append(min(most + 1, int(2 * s)))
            slack.append((m[-1] + r[-1] - most - 1) // 2)
        self.m, self.r, self.slack = np.array(m), np.array(r), np.array(slack)
        self.edges = np.array(self.low[1:])

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, side="right")


@lru_cache(maxsize=4)
def bands(percent: int, largest: int) -> Bands:
    return Bands(percent, largest)


def signatures(doc: np.ndarray, value: np.ndarray, size: np.ndarray, digest: np.ndarray, b: Bands) -> tuple[np.ndarray, ...]:
    """(key, set, flags, pair) of all segments' subsets and of the deletions of reserve segments, empty ones included."""
    out = []
    n = len(size)
    for upper in (0, 1):
        pair = b.of(size) - upper
        ok = (size > 0) & (pair >= 0)
        ok[ok] &= b.m[pair[ok]] > 1  # no difference is allowed in one segment: equal digests find those
        m = np.where(ok, b.m[np.maximum(pair, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        use = ok[doc]
        d, v = doc[use], value[use]
        part = (mix(v ^ np.uint64(0x2545F4914F6CDD1D)) % m[d].astype(np.uint64)).astype(np.int64)
        place = base[d] + part
        f = mix(v + np.uint64(0x632BE59BD9B4E019))
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, place, f)
        who = np.repeat(np.arange(n), m)
        segment = np.arange(base[-1]) - base[who]
        salt = mix((pair[who].astype(np.uint64) << np.uint64(32)) | segment.astype(np.uint64))
        heavy = segment < b.r[np.maximum(pair, 0)][who]
        flags = np.where(heavy, DOUBLE, 0) | (UPPER * upper)
        out.append((mix(total + salt), digest[who], flags.astype(np.uint8), pair[who].astype(np.int16)))
        cut = np.flatnonzero(heavy[place])
        p = place[cut]
        out.append((mix(total[p] - f[cut] + salt[p]), digest[d[cut]], np.full(len(cut), DOUBLE | DELETED | UPPER * upper, np.uint8), pair[d[cut]].astype(np.int16)))
    return tuple(np.concatenate(x) for x in zip(*out))


def stars(key: np.ndarray, node: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: place of the first row of each key's rows, and of its centre, the first lower undeleted set."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.cumsum(new) - 1, np.diff(np.append(first, len(key)))


def similar(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Groups of documents whose sets of n-word shingles have a Jaccard similarity of percent/100 or more.

    Returns (id, n_shingles, component_id): component_id is the least id that links reach. Equal sets are one class,
    by 128-bit digests. Each class's set is parted by hashed universe into as many segments as its size band may differ
    in shingles plus one: two linked sets then agree in a segment's subset. Reserve segments are indexed with their
    one-deletion neighbourhoods too and so count double; that slack lets each set give up the costliest keys (sets with
    an equal key are counted first). Sets under one key that can link by their parity sketches (which never exclude a
    link) are verified exactly from their texts: first with a centre; then, for keys whose sets are not yet in one
    component, those that may link across components form families, in which the sets of different components are
    compared exactly inside one task (by blocks if there are many). Only links that connect a family leave it, never
    its pairs. A null or empty text has 0 shingles and is its own component; rows with equal ids count as one document
    with the links of all their texts and give a row each; a text that only rows without an id have is linked with
    nothing but its copies; other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = text_bytes(docs, text_col)
    files = small_files(size // 8)
    source = docs.select(id_col, text_col)
    shards = max(1, -(-size * 8 // (100 * shard_keys)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                doc, value = shingles(texts[lo:hi], n)
                count, a, c = digests(doc, value, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(sketches(doc, value, hi - lo), pa.binary())], ["id", "size", "d", "e", "x"])

    found = materialize(source.mapInArrow(sets, f"id {kind}, size long, d long, e long, x binary"), files, True)
    largest = found.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"]
    least = found.filter("size > 0").groupBy("d", "e").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.min("x").alias("x"))
    classes = materialize(least, files)
    found = found.drop("x")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, held, sent = bands(percent, largest), [], set()

        def flush() -> pa.RecordBatch:
            key, node, flags, pair = (np.concatenate(x) for x in zip(*held))
            shard = (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            order = np.lexsort((node, key))
            key, node, flags, pair, shard = key[order], node[order], flags[order], pair[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            some, edge = shard[first], np.append(first, len(shard))
            blobs = [[x[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])] for x in (key, node, flags, pair)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["s", "key", "node", "flags", "pair"])

        rows = 0
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                doc, value = shingles(texts[lo:hi], n)
                count, a, _ = digests(doc, value, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for i, d in enumerate(a.tolist()):
                    if d not in sent and count[i]:
                        sent.add(d)
                        fresh[i] = True
                if len(sent) > 100_000:
                    sent.clear()
                use = fresh[doc]
                held.append(signatures(doc[use], value[use], np.where(fresh, count, 0), a, b))
                rows += len(held[-1][0])
                if rows >= FLUSH:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    def bucket(t: pa.Table) -> pa.Table:
        """Pairs of sets and centres (kind 0), rows of larger keys (kind 1), rows of costly keys with their cost (2)."""
        key, node, flags, pair = (np.frombuffer(b"".join(x.as_py() for x in t.column(c)), k) for c, k in (("key", np.uint64), ("node", np.uint64), ("flags", np.uint8), ("pair", np.int16)))
        order = np.lexsort((flags & (DELETED | UPPER), node, key))
        key, node, flags, pair = key[order], node[order], flags[order], pair[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, flags, pair = key[keep], node[keep], flags[keep], pair[keep]
        first, group, count = stars(key, node, flags)
        many = count[group] > 1
        key, node, flags, pair, group = key[many], node[many], flags[many], pair[many], group[many]
        full = np.bincount(group[flags & DELETED == 0], minlength=len(first)) > 0
        low = np.bincount(group[flags & UPPER == 0], minlength=len(first)) > 0
        ok = (full & low)[group]
        key, node, flags, pair, group = key[ok], node[ok], flags[ok], pair[ok], group[ok]
        cost = count[group]
        hot = cost > COSTLY
        out = [_rows(2, key[hot], node[hot], flags[hot], pair[hot], cost[hot])]
        key, node, flags, group, cost = key[~hot], node[~hot], flags[~hot], group[~hot], cost[~hot]
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            centre = np.repeat(node[new], np.diff(np.append(new, len(key))))
            a, c = np.minimum(centre, node), np.maximum(centre, node)
            ends = np.unique(np.stack([a, c])[:, a != c], axis=1)
            out.append(_rows(0, ends[0], ends[1]))
            big = cost > 2
            if big.any():
                # keys with the same sets tell the same: one of them stays
                k, v = key[big], node[big]
                new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                sizes = np.diff(np.append(new, len(k)))
                mark = mix(np.add.reduceat(mix(v), new))
                _, one = np.unique(mark, return_index=True)
                stay = np.zeros(len(new), bool)
                stay[one] = True
                stay = np.repeat(stay, sizes)
                out.append(_rows(1, np.repeat(mark, sizes)[stay], v[stay]))
        return pa.concat_tables(out)

    rows = source.mapInArrow(keys, "s int, key binary, node binary, flags binary, pair binary").groupBy("s").applyInArrow(bucket, "kind int, a long, b long, flags int, pair int, cost long")
    rows = materialize(rows, files, True)
    costly = rows.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"), "flags", "pair", "cost")
    # each set gives up its costliest keys, as far as its slack goes
    table = bands(percent, largest)
    slack = F.element_at(F.array(*(F.lit(int(x)) for x in table.slack)), F.col("pair") + 1)
    weight = F.when(F.col("flags").bitwiseAND(DOUBLE) > 0, 2).otherwise(1)
    chosen = W.partitionBy("node", "pair", F.col("flags").bitwiseAND(UPPER)).orderBy(F.desc("cost"), "key")
    heavy = costly.filter(F.col("flags").bitwiseAND(DELETED) == 0).withColumn("_given", F.sum(weight).over(chosen)).filter(F.col("_given") > slack)
    # deletions of a segment follow no single key, so they stay
    heavy = materialize(heavy.select("key", "node").union(costly.filter(F.col("flags").bitwiseAND(DELETED) > 0).select("key", "node")).distinct(), files)
    centres = materialize(heavy.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1"), fewer(files))
    joined = heavy.join(checked(centres, 24), "key")
    members = joined.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).cast("string").alias("m"), F.first("n").alias("n")).filter("n > 2")
    distinct = materialize(members.groupBy("m", "n").agg(F.min("key").alias("key")).select("key"), fewer(files))
    large = heavy.join(checked(distinct, 8), "key", "left_semi").select(F.col("key").alias("a"), F.col("node").alias("b"))
    near = rows.filter("kind = 0").select("a", "b").union(joined.filter("centre <> node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))).distinct()
    groups = materialize(rows.filter("kind = 1").select("a", "b").union(large).distinct(), files)
    near = materialize(_plausible(near, classes, percent), fewer(files), True)
    links = verified(source, near, n, percent, id_col, text_col, files)
    # an id with several texts links their classes
    several = materialize(found.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("d", "e", "size")).alias("lo"), F.max(F.struct("d", "e", "size")).alias("hi")).filter("lo <> hi").select("id"), fewer(files))
    apart = several.isEmpty()
    if not apart:
        own = found.filter("size > 0").join(checked(several, 16), "id").select("id", "d", "e").distinct().join(classes.select("d", "e", "rep"), ["d", "e"])
        links = links.union(own.filter("id <> rep").select(F.least("id", "rep").alias("u"), F.greatest("id", "rep").alias("v"))).distinct()
    links = materialize(links, fewer(files), True)
    # keys whose sets lie in several components: who may still have a link there, in groups that such links connect
    named = materialize(_components(classes, links, files), files)
    sides = groups.join(named.filter(F.col("rep").isNotNull()).select(F.col("d").alias("b"), "rep", "size", "x", "c"), "b")
    open_keys = materialize(sides.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("a", "n"), fewer(files))
    discard(rows, heavy, centres, distinct, near)
    maybe = materialize(_across(sides.join(checked(open_keys, 16), "a").select(F.col("a").alias("unit"), "n", "rep", "c", "size", "x"), percent, kind), fewer(files), True)
    if not maybe.isEmpty():
        family = materialize(components(maybe, fewer(files)).join(named.groupBy(F.col("rep").alias("node"), "c").agg(F.sum("size").alias("size")), "node"), fewer(files))
        every = materialize(links.union(_within(source, family, n, percent, id_col, text_col, files)), fewer(files), True)
        discard(named, links, family)
        links, named = every, materialize(_components(classes, every, files), files)
    discard(groups, open_keys, maybe, classes, links)
    out = found.join(named.select("d", "e", "c"), ["d", "e"], "left")
    if not apart:  # a row without words has the component of its id's other texts
        others = out.join(checked(several, 16), "id").filter("size > 0").groupBy("id").agg(F.min("c").alias("_c"))
        out = out.join(checked(others, 24), "id", "left").withColumn("c", F.coalesce("c", "_c")).drop("_c")
    else:
        discard(several)
    out = out.coalesce(files) if files else out
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def _components(classes: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """classes with the least id of their component (c)."""
    if links.isEmpty():
        return classes.withColumn("c", F.col("rep"))
    linked = components(links, fewer(files))
    return classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b: digests) that may link by size and sketch, as (u, v: ids of representatives)."""
    side = classes.select("d", "rep", "size", "x")
    both = pairs.join(side.toDF("a", "u", "s", "x"), "a").join(side.toDF("b", "v", "t", "y"), "b").filter("u <> v")
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ok, most = within(s, t, percent)
            held = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            i = np.flatnonzero(ok)
            i = i[held.distances(i, i + n) <= most[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).take(pa.array(i))

    found = both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.expr("if(u < v, s, t)").alias("s"), F.expr("if(u < v, t, s)").alias("t"), F.expr("if(u < v, x, y)").alias("x"), F.expr("if(u < v, y, x)").alias("y"))
    return found.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _blocked(members: DataFrame, blocks: Column) -> DataFrame:
    """Members of a unit in blocks of bounded size: each two blocks, and each with itself, make a unit of their own.

    Adds whether a row is on the left or the right of its unit (0 or 1; 2 in a unit of one block).
    """
    m = members.withColumn("_k", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1).cast("int")
    m = m.withColumn("side", side).withColumn("unit", F.xxhash64("unit", F.least("_b", "_o"), F.greatest("_b", "_o"))).drop("_k", "_b", "_o")
    return m


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit (first column) together, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0).to_numpy()
        edge = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(unit)]):
            if held and hi > lo and held[0].column(0)[0].as_py() != unit[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _rooted(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining those of i with those of j: each row's label is the least of its group."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _starred(label: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Links of a unit's groups as stars: one row less than each has members."""
    at = np.flatnonzero(label != np.arange(len(label)))
    u, v = rep[label[at]], rep[at]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _across(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Sets of different components under one key that may link by size and sketch, connected as stars (u, v).

    A key of more than WIDE sets is parted into blocks. What leaves a task is fewer rows than came in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches):
            rep, c, size, side = (t.column(k).to_numpy() for k in ("rep", "c", "size", "side"))
            held = Sketches(t.column("x").to_pylist())
            label = np.arange(len(rep))
            # rows come by size: partners are the next ones up to the largest that can link
            last = np.searchsorted(size, size * 100 // percent, side="right")
            count = np.maximum(last - np.arange(len(rep)) - 1, 0)
            total = np.cumsum(count)
            at = 0
            while at < len(rep):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, side="right")))
                k = count[at:upto]
                i = np.repeat(np.arange(at, upto), k)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
                at = upto
                use = (c[i] != c[j]) & ((side[i] == 2) | (side[i] != side[j])) & (label[i] != label[j])
                i, j = i[use], j[use]
                ok, most = within(size[i], size[j], percent)
                use = ok & (held.distances(i, j) <= most)
                label = _rooted(label, i[use], j[use])
            yield _starred(label, rep)

    m = _blocked(members, F.ceil(F.col("n") / F.lit(WIDE))).select("unit", "rep", "c", "size", "side", "x")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return m.repartition(parts, "unit").sortWithinPartitions("unit", "size").mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _within(source: DataFrame, family: DataFrame, n: int, percent: int, id_col: str, text_col: str, files: int) -> DataFrame:
    """Links between different components of each family (node, component, c, size), verified from the texts.

    A family's sets meet in one task, in blocks of bounded rows and bytes if it is large; its links leave as stars.
    """
    kind = source.schema[id_col].dataType.simpleString()
    wide = family.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_n") / F.lit(WIDE), F.col("_s") / F.lit(WIDE_SHINGLES)))
    sized = materialize(family.join(wide, "component"), fewer(files))
    sets = _sets(source, sized.select(F.col("node").alias("id")), n, id_col, text_col, files)
    members = _blocked(sized.select(F.col("component").alias("unit"), F.col("node").alias("rep"), "c", "size", blocks.alias("_blocks")), F.col("_blocks"))
    m = members.join(sets.withColumnRenamed("id", "rep"), "rep").select("unit", "rep", "c", "side", "x")
    m = m.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches):
            size = np.array([len(x.as_buffer()) // 8 for x in t.column("x")])
            t, size = t.take(np.argsort(size, kind="stable")), np.sort(size)
            rep, c, side = (t.column(k).to_numpy() for k in ("rep", "c", "side"))
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("x")])
            flat = np.unique(flat, return_inverse=True)[1]
            edge = np.concatenate([[0], np.cumsum(size)])
            _, own = np.unique(c, return_inverse=True)
            label = np.unique(own, return_index=True)[1][own]  # first row of each component
            label = _rooted(np.arange(len(rep)), np.arange(len(rep)), label)
            start = label
            last = np.searchsorted(size, size * 100 // percent, side="right")
            mark = np.zeros(int(flat.max(initial=-1)) + 1, np.int32)
            for i in range(len(rep)):
                lo, hi = i + 1, int(last[i])
                if hi <= lo or not ((label[lo:hi] != label[i]) & ((side[i] == 2) | (side[lo:hi] != side[i]))).any():
                    continue
                mark[flat[edge[i] : edge[i + 1]]] = 1
                common = np.add.reduceat(mark[flat[edge[lo] : edge[hi]]], edge[lo:hi] - edge[lo])
                mark[flat[edge[i] : edge[i + 1]]] = 0
                j = lo + np.flatnonzero(100 * common >= percent * (size[i] + size[lo:hi] - common))
                if len(j):
                    label = _rooted(label, np.full(len(j), i), j)
            # the components that rows came with are known already: one row of each stands for it
            first = np.flatnonzero(start == np.arange(len(rep)))
            yield _starred(np.searchsorted(first, label[first]), rep[first])

    return m.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _rows(kind: int, a: np.ndarray, b: np.ndarray, flags=None, pair=None, cost=None) -> pa.Table:
    zero = np.zeros(len(a), np.int64)
    columns = [np.full(len(a), kind, np.int32), a.view(np.int64), b.view(np.int64), *((zero if x is None else x).astype(t) for x, t in ((flags, np.int32), (pair, np.int32), (cost, np.int64)))]
    return pa.table([pa.array(c) for c in columns], ["kind", "a", "b", "flags", "pair", "cost"])


def _sets(source: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str, files: int) -> DataFrame:
    """The shingles of those documents (id, x), sorted; a row for each different text of an id."""
    kind = source.schema[id_col].dataType.simpleString()

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                doc, value = shingles(texts[lo:hi], n)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                d = digests(doc, value, hi - lo)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(d.view(np.int64)), pa.array([value[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["id", "d", "x"])

    texts = source.select(F.col(id_col).alias("id"), text_col).join(checked(materialize(ids.distinct(), fewer(files)), 8), "id", "left_semi")
    return texts.mapInArrow(blobs, f"id {kind}, d long, x binary").filter(F.length("x") > 0).dropDuplicates(["id", "d"]).drop("d")


def verified(source: DataFrame, pairs: DataFrame, n: int, percent: int, id_col: str, text_col: str, files: int) -> DataFrame:
    """Those pairs (u, v: a table) of documents that link, from the shingles of their texts.

    A document with many pairs, as a centre is, goes to as many places as it has PAIRS pairs.
    """
    kind = source.schema[id_col].dataType.simpleString()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    held = _sets(source, pairs.select(F.col("u").alias("id")).union(pairs.select("v")), n, id_col, text_col, files)
    ends = pairs.select(F.col("u").alias("id"), F.lit("u").alias("end")).union(pairs.select("v", F.lit("v")))
    busy = materialize(ends.groupBy("id", "end").count().filter(F.col("count") > PAIRS).select("id", "end", F.ceil(F.col("count") / PAIRS).cast("int").alias("k")), fewer(files))

    def spread(df: DataFrame, here: str, there: str, blob: str) -> DataFrame:
        many = checked(busy.filter(F.col("end") == here).select(F.col("id").alias(here), "k"), 12)
        salted = df.join(many, here, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(there), F.col("k")).cast("int"), F.lit(0))).drop("k")
        copies = held.toDF(here, blob).join(many, here, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1))).drop("k")
        return salted.join(copies, [here, "_s"]).drop("_s")

    both = spread(spread(pairs, "u", "v", "x"), "v", "u", "y").select("u", "v", "x", "y")
    return both.mapInArrow(exact, f"u {kind}, v {kind}")
