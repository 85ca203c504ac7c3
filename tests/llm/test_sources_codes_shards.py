"""Source divergence, vector codes and sharding against plain computations, and their edge cases."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import codes, common, divergence, sharding

DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least, ranks):
    read = [tuple(x or "" for x in r[1:]) for r in rows]
    words = [re.findall(divergence.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) for text, _, _ in read]
    out = []
    for lang in {r[1] for r in read}:
        mine = [(w, r[2]) for w, r in zip(words, read) if r[1] == lang]
        docs = Counter(x for w, _ in mine for x in set(w))
        kept = {x for x, n in docs.items() if n >= least}
        count = defaultdict(Counter)
        for w, source in mine:
            count[source].update(x for x in w if x in kept)
        everything = sum(count.values(), Counter())
        price = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}
        q = price(everything)
        for a in count:
            p = price(count[a])
            pairs = [(b, sum(abs(p[x] - price(count[b])[x]) for x in kept)) for b in count if b != a]
            terms = [(x, p[x] - q[x]) for x in kept if count[a][x] and p[x] > q[x]]
            for part, found, top in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(found[:top])]
    return sorted(out)


def random_docs(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "don't", "日本", "Zed"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 15))), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 7)}") for i in range(n)]
    return rows + [(None, None, None, None), (1, "", "en", "only"), (1, "", "en", "only"), (2, "w1 W1 w1", None, "s1"), (3, "word " * 20_000, "de", None), (4, "lonely", "fr", "x"), (5, "w1", "", "s2")]


@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_divergence_equals_plain_sums(spark, least):
    rows = random_docs(150, least)
    got = divergence.audit(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("term", "words", "n", "p", "zero")}), least, 7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, 7)


def test_divergence_dealt_out(spark, monkeypatch):
    rows = random_docs(80, 3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS), 2).collect())) == plain_audit(rows, 2, 50)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    assert divergence.audit(spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s")], DOCS)).count() == 0


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, lab, [int(np.floor(np.float64(256) * x)) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(r[2][p * width : (p + 1) * width]) for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(books[p][e], x), e))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(p, c[p])].append(c[p])
            books[p] = [tuple(sum(x) // len(held[e]) for x in zip(*held[e])) if e in held else old for e, old in enumerate(books[p])]
    code = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(far(books[p][e], c[p]) for p, e in enumerate(cc)) for cc, c in zip(code, cut)]
    label = Counter()
    for (_, lab, _), e in zip(kept, error):
        label[lab] += e
    return sorted((str(r[0]), str(r[1]), "".join(f"{e:02x}" for e in c), e, label[r[1]]) for r, c, e in zip(kept, code, error)), books


def vectors(n, seed, size=8, grid=None):
    rng = np.random.default_rng(seed)
    values = rng.standard_normal((n, size)) / 4 if grid is None else rng.integers(-grid, grid + 1, (n, size)) / 256
    rows = [(i, int(rng.integers(0, 3)) if i % 5 else None, v.astype(np.float32).tolist()) for i, v in enumerate(values)]
    bad = [None, [], [None] * size, [float("nan")] + [0.0] * (size - 1), [float("-inf")] * size]
    return rows + [(1000 + i, 1, v) for i, v in enumerate(bad)] + rows[3:5] + [(None, None, rows[0][2])]


@pytest.mark.parametrize(("n", "entries", "grid"), [(200, 20, None), (150, 64, 2), (5, 64, None), (120, 40, 1)])
def test_codes_equal_plain_search(spark, n, entries, grid, monkeypatch):
    rows = vectors(n, n, grid=grid)
    if n == 150:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "code", "error", "salt")})
    got, books = codes.compress(df, 4, entries)
    want, plain = plain_codes(rows, 4, entries, 2)
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got.collect()) == want
    assert books.tolist() == [[list(e) for e in b] for b in plain]
    assert codes.digest(books) == codes.digest(np.array(plain))


def test_codes_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, [float("nan")] * 16)], "vec_id long, label int, embedding array<double>")
    got, books = codes.compress(df)
    assert got.count() == 0 and books.shape[1] == 0
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, 1, [1e30] * 16)], "vec_id long, label int, embedding array<double>"))


@pytest.mark.parametrize(("entries", "width", "grid"), [(64, 4, 30), (64, 4, 2), (200, 1, 50), (7, 3, 1), (64, 2, 1 << 28)])
def test_tree_finds_the_first_of_the_nearest(entries, width, grid):
    rng = np.random.default_rng(entries + grid)
    book, points = rng.integers(-grid, grid + 1, (entries, width)), rng.integers(-grid, grid + 1, (500, width))
    index, far = codes.Tree(book).nearest(points)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(index, every.argmin(axis=1)) and np.array_equal(far, every.min(axis=1))


def test_tree_skips_entries():
    rng = np.random.default_rng(1)
    book, points = rng.integers(-200, 200, (64, 4)), rng.integers(-200, 200, (2_000, 4))
    tree, seen = codes.Tree(book), []
    compared = tree._compared
    tree._compared = lambda entry, points, rows, *a: seen.append(len(rows)) or compared(entry, points, rows, *a)
    tree.nearest(points)
    assert sum(seen) < 0.7 * 64 * len(points)


def held(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("size", "shard", "row", "n", "g1")})
    got = sharding.shard(df, shards).toPandas()
    assert sorted(map(str, got["doc_id"].astype("Int64"))) == sorted("<NA>" if r[0] is None else str(r[0]) for r in rows)
    count = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert count.max() - count.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == want
    return sharding.cut(spark.createDataFrame(got[["size", "text_crc32", "shard"]], "size long, text_crc32 long, shard int")).first()["cut"]


def least_cut(groups, shards):
    """Of all ways to deal rows of groups to even shards."""
    rows = [g for g, n in enumerate(groups) for _ in range(n)]
    most = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    best = None
    for way in product(range(shards), repeat=len(rows)):
        if sorted(map(way.count, range(shards))) == sorted(most):
            cut = sum(rows[i] == rows[j] and way[i] != way[j] for i in range(len(rows)) for j in range(i))
            best = cut if best is None else min(best, cut)
    return best


@pytest.mark.parametrize(("groups", "shards"), [([4, 4], 2), ([3, 2, 1, 1, 1], 2), ([5, 1, 1, 1], 2), ([2, 2, 2, 1, 1], 3), ([8], 2), ([1] * 7, 3)])
def test_shards_cut_as_little_as_can_be(spark, groups, shards):
    rows = [(i, f"text {g}") for i, g in enumerate(g for g, n in enumerate(groups) for _ in range(n))]
    assert held(spark, rows, shards) == least_cut(groups, shards)


def test_shards_of_many_groups(spark):
    rows = [(i, f"text {i % 60}") for i in range(480)] + [(None, "own"), (7, None), (7, ""), (8, "long " * 50_000)] + [(9, "same")] * 40 + [(10_000 + i, f"one {i}") for i in range(200)]
    assert held(spark, rows, 24) <= 30 * 10  # 724 rows make shards of 30 or 31: the group of 40 can't stay whole, all others can


def test_shards_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    monkeypatch.setattr(sharding, "QUEUE", 2)
    rows = [(i, "hot") for i in range(300)] + [(i, f"pair {i // 2}") for i in range(300, 600)] + [(i, f"one {i}") for i in range(600, 900)]
    # at best 300 rows fill seven shards of 38 rows and 34 places of another, and nothing else is cut
    assert held(spark, rows, 24) <= 1.05 * (300 * 299 - 7 * 38 * 37 - 34 * 33) / 2


def test_shards_without_room(spark):
    rows = [(i, f"text {i // 3}") for i in range(144)]  # all linked, 6 in each shard
    assert held(spark, rows, 24) <= 0.3 * 144


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, "a")] * 30])
def test_shards_of_few_rows(spark, rows):
    held(spark, rows, 24)


def test_quotas_keep_loads():
    rng = np.random.default_rng(2)
    for _ in range(200):
        wanted = rng.integers(0, 9, (6, 6)) * rng.integers(0, 2, (6, 6))
        np.fill_diagonal(wanted, 0)
        free = rng.integers(0, 6, 6)
        x = sharding.quotas(wanted, free)
        assert (0 <= x).all() and (x <= wanted).all() and (x.sum(axis=0) - x.sum(axis=1) <= free).all()
