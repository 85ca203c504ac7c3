"""Substring dedup: a count-min prefilter over window hashes, then exact groups of what it calls repeated."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, text_bytes
from .textops import covered, inside, mix, owner, windows, words

#: Bytes of text in a block (one task's unit), windows in a shard of the sketch, cells for each window in each row.
BLOCK_BYTES, SHARD_WINDOWS, CELLS = 8 << 20, 1 << 21, 8
ROWS = (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)
#: Stands for a null id, which so is as large as any other.
NO_ID = (1 << 63) - 1


def packed(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed byte planes of their differences."""
    d = np.diff(a, prepend=a[:1] * 0) if len(a) else a
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(len(d), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


class Block:
    """Windows of the documents of one block, the same each time it is read: documents in order of id and text."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, texts: list[bytes], k: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], none[i], texts[i]))
        self.ids, self.none, self.k = ids[order], none[order], k
        self.texts = [texts[i] for i in order]
        parts, sizes = [], []
        start = size = 0
        for i, text in enumerate([*self.texts, b""]):
            if i == len(self.texts) or (i > start and size + len(text) > SLICE_BYTES):
                got, bounds = words(self.texts[start:i])
                parts.append(got)
                sizes.append(np.diff(bounds))
                start, size = i, 0
            size += len(text)
        self.hashes = np.concatenate(parts)
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        grams = windows(self.hashes, k)
        self.at = np.flatnonzero(inside(self.bounds, k, len(grams))) if len(grams) else np.empty(0, np.int64)
        self.grams = grams[self.at]
        self.doc = owner(self.bounds)[self.at]
        order = np.argsort(self.grams, kind="stable")  # the first of equal windows is in the smallest document
        ordered = self.grams[order]
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        self.unique, self.first = ordered[new], order[new]
        self.least = self.ids[self.doc[self.first]] if len(new) else np.empty(0, np.int64)

    def second(self) -> np.ndarray:
        """Hashes of the same windows in the second lane."""
        return windows(words_of(self), self.k, 1)[self.at]

    def shards(self, n: int):
        """(shard, slice of the unique windows); windows are parted by their high bits, so each is one run."""
        edge = np.searchsorted(self.unique, np.array([-(-(s << 64) // n) for s in range(1, n)], np.uint64))
        for s, (lo, hi) in enumerate(zip([0, *edge], [*edge, len(self.unique)])):
            if lo < hi:
                yield s, slice(int(lo), int(hi))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(ROWS[row])) % np.uint64(width)).astype(np.uint32)


def drop_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Removes words covered by windows of k words that start in a document with a smaller id too.

    Returns (id, n_words, n_removed, kept_text: kept words joined by one space). First pass: each block of documents
    makes a sparse partition sketch (two rows of count-min cells) by shard of the hash space; the sketches of a shard
    are summed, and each block learns which of its cells count two blocks or more. These counts overestimate, so no
    repeated window is lost. Second pass: only windows whose cells all do are sent, with 128-bit hashes, and grouped
    exactly for the smallest id. Repeats inside a block are found there. Shards and blocks are sized by the corpus and
    bound every task's memory; a frequent window counts once a block, and rows are dealt to blocks by id and text, so
    that rows of one id or without id spread. Windows are equal if both of their 64-bit hashes are. A null or empty text
    has 0 words and an empty kept_text; rows with equal ids count as one document for the rule and give a row each, a
    null id counts as the largest; other columns are dropped.
    """
    size = text_bytes(docs, text_col)
    blocks, shards = max(1, -(-size // block_bytes)), max(1, -(-size // (6 * shard_windows)))
    width = CELLS * min(shard_windows, max(1 << 12, size // 4))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    source = docs.select(dealt.alias("b"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(id_col).isNull().alias("none"), F.col(text_col).cast("binary").alias("text"))
    source = source.repartition(max(parts, min(blocks, 10_000)), "b")

    def block(t: pa.Table) -> Block:
        return Block(*(t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "none")), [x or b"" for x in t.column("text").to_pylist()], k)

    def sketch(t: pa.Table) -> pa.Table:
        b, found = block(t), []
        for s, part in b.shards(shards):
            found.append((s, t.column("b")[0].as_py(), *(packed(np.sort(cells(b.unique[part], r, width))) for r in (0, 1))))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*found) if found else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["s", "b", "r0", "r1"])

    def merge(t: pa.Table) -> pa.Table:
        out = []
        for row in ("r0", "r1"):
            total = np.zeros(width, np.uint8)
            parts = t.column(row).to_pylist()
            for data in parts:
                c, n = np.unique(unpacked(data, np.uint32), return_counts=True)
                total[c] = np.minimum(2, total[c] + np.minimum(n, 2))
            out.append(pa.array([np.packbits(total[unpacked(data, np.uint32)] >= 2).tobytes() for data in parts], pa.binary()))
        return pa.table([t.column("b"), t.column("s"), *out], ["b", "s", "m0", "m1"])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        masks = {r["s"]: r for r in right.to_pylist()}
        if left.num_rows and masks:
            b = block(left)
            second = b.second()
            for s, part in b.shards(shards):
                ok = np.ones(part.stop - part.start, bool)
                for r in (0, 1):
                    c = cells(b.unique[part], r, width)
                    ordered = np.argsort(c, kind="stable")
                    ok[ordered] &= np.unpackbits(np.frombuffer(masks[s][f"m{r}"], np.uint8), count=len(c)).astype(bool)
                if ok.any():
                    found.append((s, left.column("b")[0].as_py(), packed(b.unique[part][ok]), second[b.first[part]][ok].tobytes(), zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(b.least[part][ok].view(np.uint8).reshape(-1, 8).T).tobytes())))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*found) if found else [()] * 5, kinds)], ["s", "b", "h", "h2", "ids"])

    def group(t: pa.Table) -> pa.Table:
        h = [unpacked(x, np.uint64) for x in t.column("h").to_pylist()]
        second = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("h2").to_pylist()])
        ids = np.concatenate([np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in t.column("ids").to_pylist()])
        first = np.concatenate(h)
        order = np.lexsort((ids, second, first))
        new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later, out, at = least < ids, [], 0
        for part in h:
            out.append(packed(part[later[at : at + len(part)]]))
            at += len(part)
        return pa.table([t.column("b"), t.column("s"), pa.array(out, pa.binary())], ["b", "s", "h"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["id", "n_words", "n_removed", "kept_text"])
        b = block(left)
        repeated = np.zeros(len(b.unique), bool)
        for data in right.column("h").to_pylist():
            repeated[np.searchsorted(b.unique, unpacked(data, np.uint64))] = True
        which = np.searchsorted(b.unique, b.grams)
        gone = np.empty(0, bool)
        if len(b.grams):
            here = b.least[which] < b.ids[b.doc]  # by one hash; the other decides
            if here.any():
                second = b.second()
                here &= second == second[b.first[which]]
            gone = repeated[which] | here
        removed = covered(b.at[gone], k, len(b.hashes))
        kept = []
        for i, text in enumerate(b.texts):
            lost = removed[b.bounds[i] : b.bounds[i + 1]]
            found = text.split()
            kept.append(b" ".join(found if not lost.any() else [w for w, x in zip(found, lost.tolist()) if not x]))
        total = np.concatenate([[0], np.cumsum(removed)])
        return pa.table([pa.array(b.ids, mask=b.none), pa.array(np.diff(b.bounds), pa.int64()), pa.array(total[b.bounds[1:]] - total[b.bounds[:-1]], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    grouped = source.groupBy("b")
    masks = grouped.applyInArrow(sketch, "s int, b int, r0 binary, r1 binary").groupBy("s").applyInArrow(merge, "b int, s int, m0 binary, m1 binary")
    sent = grouped.cogroup(masks.groupBy("b")).applyInArrow(candidates, "s int, b int, h binary, h2 binary, ids binary")
    repeats = sent.groupBy("s").applyInArrow(group, "b int, s int, h binary")
    out = grouped.cogroup(repeats.groupBy("b")).applyInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)


def words_of(b: Block) -> np.ndarray:
    """The block's word hashes in the second lane."""
    parts = []
    start = size = 0
    for i, text in enumerate([*b.texts, b""]):
        if i == len(b.texts) or (i > start and size + len(text) > SLICE_BYTES):
            parts.append(words(b.texts[start:i], 1)[0])
            start, size = i, 0
        size += len(text)
    return np.concatenate(parts)
