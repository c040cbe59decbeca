"""The join against all pairs by brute force."""

import random

import numpy as np

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import DATA
from pyspark.sql import functions as F

from episode_mart.llm import neardup
from episode_mart.llm.graphs import components
from episode_mart.llm.queries import QUERIES


def sets(rows, words):
    out = []
    for doc, text in rows:
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = [w for w in found.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
                 .replace("\r", " ").split(" ") if w]
        grams = {tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else (
            {tuple(found)} if found else set())
        out.append((doc, grams))
    return out


def brute(rows, words, percent):
    """(doc, size, component) of every row, in order."""
    of = sets(rows, words)
    parent = list(range(len(of)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted(range(len(of)), key=lambda i: len(of[i][1]))
    for x, i in enumerate(by_size):
        a = of[i][1]
        for j in by_size[x + 1:]:
            b = of[j][1]
            if not a or percent * len(b) > 100 * len(a):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(of):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, len(g), least.get(root(i))) for i, (doc, g) in enumerate(of)]


def none_first(rows):
    return sorted(rows, key=lambda r: [(v is not None, v or 0) for v in r])


def test_query_equals_brute_force(spark):
    docs = pq.read_table(f"{DATA}/sf0.01/documents.parquet").to_pylist()
    got = QUERIES["op5_ngram_jaccard"](spark, f"{DATA}/sf0.01").collect()
    expected = brute([(d["doc_id"], d["text"]) for d in docs], 3, 90)
    assert sorted(map(tuple, got)) == sorted(expected)
    assert sum(d != c for d, _, c in expected) > 50


def made(seed):
    """Families around a base text with few or many changes, chains, copies, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(words) for _ in range(12))
    rows = [(None, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "one two"), (None, "one two"),
            (906, "ONE two three"), (907, "İ two three"), (908, "i̇ two three"), (903, "One"), (910, None)]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 40, 90, 200]))]
        current = base
        for k in range(rng.choice([2, 8, 30])):
            text = list(base if family % 3 else current)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            current = text
            body = " ".join(text)
            rows.append((family * 50 + k, f"{line} {body}" if rng.random() < 0.3 else body))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, percent, heavy, block",
                         [(1, 3, 90, 1000, 512), (2, 5, 80, 1000, 8), (3, 3, 90, 10, 4), (4, 2, 70, 5, 16), (5, 1, 50, 8, 3)])
def test_made_families(spark, monkeypatch, seed, words, percent, heavy, block):
    monkeypatch.setattr(neardup, "HEAVY", heavy)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = made(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, row string")
    got = neardup.join(df.repartition(3), words=words, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert none_first(map(tuple, got.collect())) == none_first(brute(rows, words, percent))


def test_large_tiles_are_cut_by_size(spark, monkeypatch):
    """One shingle in all texts, in sizes from 20 to 400 words: bands and blocks miss no pair and meet no far one."""
    monkeypatch.setattr(neardup, "BLOCK", 6)
    mixed = spark.createDataFrame([(1, i, n, i, 200) for i, n in enumerate(range(20, 420, 2))]
                                  + [(2, i, 50, i, 4) for i in range(4)], "key long, node long, n long, root long, m long")
    for percent in (50, 80, 90, 99, 100):
        rows = neardup._blocks(mixed, percent).collect()
        small = [r for r in rows if r["key"] == 2]
        assert len(small) == 4 and all(r["own"] == 0 and r["others"] == [0] for r in small)
        large = [r for r in rows if r["key"] == 1]
        for x in large:
            assert x["own"] in x["others"] and len(set(x["others"])) == len(x["others"])
            for y in large:
                near = 100 * min(x["n"], y["n"]) >= percent * max(x["n"], y["n"])
                meets = y["own"] in x["others"]
                assert meets == (x["own"] in y["others"]) and (meets or not near)
                far = 100 ** 3 * min(x["n"], y["n"]) < percent ** 3 * max(x["n"], y["n"])
                assert not (percent < 99 and far and meets)


def test_empty_table(spark, frame):
    assert neardup.join(frame([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    links += [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (10, 12), (50, 200), (300, 5000)):
        u, v = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        u, v = u[u != v], v[u != v]
        score = rng.integers(0, 4, len(u)) / 4
        picked = neardup._forest(u, v, score)

        def parts(edges):
            parent = {x: x for x in [*u, *v]}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x
            for e in edges:
                parent[root(u[e])] = root(v[e])
            return {x: min(y for y in parent if root(y) == root(x)) for x in parent}
        whole = parts(range(len(u)))
        assert parts(picked) == whole
        assert len(picked) == len(whole) - len(set(whole.values()))


def test_bitmaps_of_any_two_sizes_bound_the_overlap(spark):
    rng = np.random.default_rng(5)
    sets_, pairs = [], []
    for size in (1, 30, 250, 258, 500, 530, 1000, 1100, 2000, 2100, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        other = np.unique(np.concatenate([base[: max(1, size * 19 // 20)], rng.integers(0, 1 << 63, size // 8, np.uint64)]))
        sets_ += [base, other]
    lengths, folds = neardup._folds(pa.array([neardup._parity(x) for x in sets_], pa.list_(pa.int64())))
    for i, a in enumerate(sets_):
        for j, b in enumerate(sets_):
            bits = folds[min(lengths[i], lengths[j])]
            d = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert d <= len(np.setxor1d(a, b))
            pairs.append(([int(x) for x in neardup._parity(a)], [int(x) for x in neardup._parity(b)], d))
    got = spark.createDataFrame(pairs, "a array<long>, b array<long>, d int").select(
        "d", neardup._differing(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(r["d"] == r["e"] for r in got) and set(lengths) == {4, 8, 16, 32}


def test_sizes_on_both_sides_of_a_bitmap_length(frame):
    rng, rows = random.Random(6), []
    for size in (255, 262, 510, 520, 1020, 1040, 2040, 2070, 4000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for n in (0, 3, size // 60, size // 25, size // 12):
            rows.append((len(rows), " ".join(words + [f"x{rng.randrange(10**6)}" for _ in range(n)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.join(frame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (n, c) for d, n, c in brute(rows, neardup.WORDS, neardup.PERCENT)}


@pytest.mark.parametrize("percent", [80, 90])
def test_bitmaps_tell_long_texts_apart(percent):
    """Sets of thousands of shingles without a common one do not pass, those near enough do."""
    rng = np.random.default_rng(7)
    for size in (300, 800, 3000, 5000, 9000, 12000, 20000):
        sets_ = [np.unique(rng.integers(0, 1 << 63, size, np.uint64)) for _ in range(4)]
        sets_ += [x[: size * (percent + 5) // 100] for x in sets_]
        lengths, folds = neardup._folds(pa.array([neardup._parity(x, percent) for x in sets_], pa.list_(pa.int64())))
        n, passed = np.array([len(x) for x in sets_]), set()
        i, j = np.triu_indices(len(sets_), 1)
        for words, bits in folds.items():
            some = np.minimum(lengths[i], lengths[j]) == words
            a, b, differing, sizes = neardup._passing(bits, i[some], j[some], (n[i] + n[j])[some], percent)
            assert (sizes == n[a] + n[b]).all()
            assert all(d == np.bitwise_count(bits[x] ^ bits[y]).sum() for x, y, d in zip(a, b, differing, strict=True))
            passed |= set(zip(a.tolist(), b.tolist(), strict=True))
        assert passed == {(k, k + 4) for k in range(4)}


def test_settled_tiles_are_not_compared_twice(spark, frame, monkeypatch):
    """Texts that share passages but do not link, and families that do: the second round has little left."""
    rng, rows, sizes, crossing = random.Random(8), [], [], neardup._crossing
    line = [f"c{i}" for i in range(30)]
    for family in range(40):
        base = line + [f"w{rng.randrange(10**6)}" for _ in range(30)]
        for k in range(3):
            rows.append((len(rows), " ".join(base[:-1] + [f"x{rng.randrange(10**6)}"] if k else base)))

    def counted(mixed, *rest):
        sizes.append(mixed.count())
        return crossing(mixed, *rest)

    monkeypatch.setattr(neardup, "_crossing", counted)
    got = {tuple(r) for r in neardup.join(frame(rows, "doc_id long, text string"), words=3, percent=80).select(
        "doc_id", "n_shingles", "component_id").collect()}
    assert got == set(brute(rows, 3, 80))
    assert sizes[0] > 100 and sizes[1] == 0


def test_a_pair_of_many_common_shingles_is_made_once(frame, monkeypatch):
    """Families of texts somewhat less alike than asked for: rows grow with the pairs, not with their common shingles."""
    rng, rows, made, crossing = random.Random(9), [], [], neardup._crossing
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(30):
            text = list(base)
            for at in rng.sample(range(400), rng.choice([7, 9, 10, 11])):
                text[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))

    def counted(*args):
        pairs = crossing(*args)
        made.append((pairs.count(), pairs.select("a", "b").distinct().count()))
        return pairs

    monkeypatch.setattr(neardup, "_crossing", counted)
    got = {tuple(r) for r in neardup.join(frame(rows, "doc_id long, text string"), words=3, percent=80).select(
        "doc_id", "n_shingles", "component_id").collect()}
    assert got == set(brute(rows, 3, 80))
    assert made[0][1] > 0 and all(n <= 1.5 * pairs for n, pairs in made) and made[1][0] < len(rows)


def test_pairs_that_meet_in_several_tiles_are_all_made(spark, monkeypatch):
    """With bitmaps that let all pass: each pair of different roots and near sizes in a common tile, few of them twice."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(10)
    of = {node: (rng.choice([20, 22, 24, 40]), rng.randrange(12)) for node in range(40)}
    tiles = {key: rng.sample(sorted(of), rng.choice([2, 4, 12, 30])) for key in range(-20, 20)}
    mixed = spark.createDataFrame([(key, v, *of[v], len(t)) for key, t in tiles.items() for v in t],
                                  "key long, node long, n long, root long, m long")
    nodes = spark.createDataFrame([(v, [0] * 4, [0] * 8) for v in of], "node long, bits array<long>, fine array<long>")
    expected = {(a, b) for t in tiles.values() for a in t for b in t
                if a < b and of[a][1] != of[b][1] and 100 * min(of[a][0], of[b][0]) >= 80 * max(of[a][0], of[b][0])}
    got = [tuple(r) for r in neardup._crossing(mixed, nodes, 80, False).select("a", "b").collect()]
    assert set(got) == expected and all(set(pair) <= set(tiles[r]) for r, *pair in neardup._crossing(mixed, nodes, 80, True).select("key", "a", "b").collect())
    met = [sum(a in t and b in t for t in tiles.values()) for a, b in expected]
    assert len(got) < sum(met)


def test_lists_with_a_common_value():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 9, rng.integers(0, 4)).tolist() for _ in range(30)]
    i, j = np.triu_indices(20, 1)
    some = pa.array(lists, pa.list_(pa.int64())).slice(10)
    assert neardup._met(some, i, j).tolist() == [bool(set(lists[10 + x]) & set(lists[10 + y])) for x, y in zip(i, j, strict=True)]
    assert not neardup._met(pa.array([[], []], pa.list_(pa.int64())), np.array([0]), np.array([1])).any()
