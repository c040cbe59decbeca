"""N-gram Jaccard join: groups of documents whose sets of word shingles overlap.

Documents with equal sets are one node. Two nodes whose Jaccard similarity reaches the threshold share a
shingle among the first n - ceil(t n) + 1 of either set, whatever the common order of shingles; the order
here is by hash, with shingles of very many prefixes last. Nodes that share such a shingle form a tile.

1. The first node of each tile is compared with the others. Of the pairs that may link, every node's
   likeliest is verified, which makes most of every group one component.
2. What a tile then holds of different components, near enough in size, is compared with each other. Of the pairs that may link,
   a spanning forest is verified.
3. The tiles of which a pair of that forest still lies in two components are compared once more, and all their pairs of
   different components that may link are verified. In the other tiles the forest has joined all that may link.

Only |A| >= t |B| can link. A tile of more than BLOCK nodes is cut into bands of sizes, each as wide as this
ratio, and bands into blocks: a block meets the blocks of its own band and of the two bands beside it, no
others. Within tiles and blocks nodes are sorted by size, and each meets only those that are near enough.
Near sets share many tiles. A pair counts in the first of them by key, and is left out of those in which both nodes have
a common tile among the ``EARLIER`` before; so pairs grow with the pairs there are, not with the shingles that they share.

A pair is compared by parity bitmaps of hashed shingles: common shingles cancel out, so the bit count of
their difference bounds the overlap from above. A bitmap has ``SPARE`` times as many bits as two sets of that size may differ in
shingles and still link, up to ``BITS``: sets without common shingles then differ in half of the bits, which is too many.
Step 3, which meets few tiles, takes bitmaps with ``FINE`` times as many: they tell apart most sets that differ little more than allowed.
Folded by exclusive or it is the bitmap of fewer bits, so sets of any sizes compare. Pairs that pass are verified exactly by intersecting the
sorted shingle arrays, computed from the whole texts. No pair of one component is compared twice for
nothing and none of two components is left out, so components are exact.

Every join is an equality join that adaptive execution can split, hot tiles are cut into blocks, copies
are one node before tiles are formed, and intermediate tables lie in the shared folder.

Defined cases: null, empty and blank texts have no shingles and are alone; a text of fewer words than a
shingle is one shingle; a null id takes part, and a component of null ids alone has a null id; repeated
rows are copies. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episode_mart.llm.common import Scratch, keep, texts
from episode_mart.llm.graphs import components

WORDS = 3
PERCENT = 90
BITS = 1 << 14  # enough for sets of 25,000 shingles at 80 percent, 50,000 at 90
SPARE, FINE = 3, 12
BLOCK = 2048
HEAVY = 10_000
COMPARED = 200_000
WORDS_AT_ONCE = 1 << 20  # 64-bit words of bitmaps that are compared in one step
EARLIER = 4  # tiles of a node before the one at hand, by which pairs are told that have met there
FIRST = 4  # 64-bit words of the bitmaps that are compared before the others
BUCKETS = 1 << 20

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ADD = np.uint64(0x94D049BB133111EB)


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z are lower-cased."""
    found = body.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    n = len(found) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i:i + n]
    out = (out ^ (out >> np.uint64(31))) * _ADD
    return np.unique(out ^ (out >> np.uint64(30)))


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _parity(found: np.ndarray, percent: int = PERCENT, spare: int = SPARE) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls in a bucket, as 64-bit integers.

    The number of bits is the power of two from 64 ``FIRST`` to BITS that is not below ``spare`` times the number of
    shingles in which two sets of this size may differ.
    """
    bits, enough = 64 * FIRST, spare * 2 * (100 - percent) * len(found) / (100 + percent)
    while bits < min(enough, BITS):
        bits *= 2
    counts = np.bincount((found >> np.uint64(40)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _differing(a: Column, b: Column) -> Column:
    """Bits that differ between two bitmaps, the longer one folded to the length of the other."""
    words = F.least(F.size(a), F.size(b))

    def folded(bits: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("long"),
                           lambda x, k: x.bitwiseXOR(F.get(bits, k)))
    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda n, i: n + F.bit_count(
        folded(a, i).bitwiseXOR(folded(b, i))))


def _folds(bits: pa.ListArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each bitmap, and the bitmaps folded to each length; rows of shorter ones are 0 there."""
    lengths = np.diff(np.asarray(bits.offsets))
    flat, starts = np.asarray(bits.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = {}
    for words in np.unique(lengths):
        out[int(words)] = into = np.zeros((len(lengths), words), np.uint64)
        for longer in np.unique(lengths[lengths >= words]):
            rows = np.flatnonzero(lengths == longer)
            whole = flat[starts[rows][:, None] + np.arange(longer)]
            into[rows] = np.bitwise_xor.reduce(whole.reshape(len(rows), -1, words), axis=1)
    return lengths, out


def signatures(docs: DataFrame, id_column: str, text: str, words: int, percent: int,
               heavy: np.ndarray | None = None) -> DataFrame:
    """(doc_id, row, n, node, prefix, bits, fine) per row; node is null without shingles, the lists are empty."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(id_column).cast("long"), F.col(text)).alias("row"),
                       F.col(text).alias("text"))
    last = docs.sparkSession.sparkContext.broadcast(heavy if heavy is not None else np.empty(0, np.uint64))

    def run(batches):
        heavy, none = last.value, np.empty(0, np.int64)
        for batch in batches:
            sizes, nodes, at, prefixes, maps = [], [], [0], [], {SPARE: [], FINE: []}
            for body in batch.column(2).cast(pa.binary()):  # one text at a time beside the batch
                found = shingles(body.as_py() or b"", words)
                n = len(found)
                sizes.append(n)
                if n:
                    nodes.append(int(xxhash.xxh64_intdigest(found.tobytes())) - (1 << 63))
                    p = prefix_length(n, percent)
                    for spare, bits in maps.items():
                        bits.append(_parity(found, percent, spare))
                    if len(heavy) and np.isin(found[:p], heavy).any():
                        late = np.isin(found, heavy)
                        found = np.concatenate([found[~late], found[late]])
                    prefixes.append(found[:p].view(np.int64))
                    at.append(at[-1] + p)
                else:
                    nodes.append(None)
                    at.append(at[-1])
                    for bits in maps.values():
                        bits.append(none)
            flat = np.concatenate([none, *prefixes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                 *(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]), pa.int32()),
                                            pa.array(np.concatenate([none, *bits]))) for bits in maps.values())],
                ["doc_id", "row", "n", "node", "prefix", "bits", "fine"])

    return rows.mapInArrow(run, "doc_id long, row long, n long, node long, prefix array<long>, bits array<long>, fine array<long>")


def _may_link(percent: int, na: Column, nb: Column, differing: Column | None = None) -> Column:
    """By sizes; with the number of differing bits, by the bound (na + nb - differing) / 2 of the overlap."""
    if differing is None:
        return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return (100 + percent) * (na + nb - differing) >= 2 * percent * (na + nb)


def _stars(tiles: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a tile's first node and another that pass sizes and bitmaps, with the share that differs."""
    pairs = tiles.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    near = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
            .where(_may_link(percent, F.col("na"), F.col("nb"))))
    with_bits = near.join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
    return with_bits.withColumn("d", _differing(F.col("ba"), F.col("bb"))).where(_may_link(percent, F.col("na"), F.col("nb"), F.col("d"))).select(
        "a", "b", (F.col("d") / (F.col("na") + F.col("nb"))).alias("score"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Every node's pair with the least difference."""
    def end(node: str, other: str) -> Column:
        return F.struct(F.col(node).alias("node"), F.struct("score", F.col(other).alias("other")).alias("pair"))
    ends = pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("end")).select("end.*")
    best = ends.groupBy("node").agg(F.min("pair").alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def _forest(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of edges (u, v) that connect all that the edges connect, least scores first, without cycles."""
    labels, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[:len(u)], ends[len(u):]
    component, chosen = np.arange(len(labels)), np.zeros(len(u), bool)
    while True:
        cu, cv = component[u], component[v]
        edges = np.flatnonzero(cu != cv)
        if not len(edges):
            return np.flatnonzero(chosen)
        own, other, edge = (np.concatenate(p) for p in ((cu[edges], cv[edges]), (cv[edges], cu[edges]), (edges, edges)))
        order = np.lexsort((edge, score[edge], own))
        first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
        chosen[edge[first]] = True
        parent = np.arange(len(labels))
        parent[own[first]] = other[first]
        twice = parent[parent] == np.arange(len(labels))  # two components that chose each other
        parent[twice & (np.arange(len(labels)) < parent)] = np.flatnonzero(twice & (np.arange(len(labels)) < parent))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        component = parent[component]


def _parted(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose nodes lie in different components so far."""
    ra, rb = (found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _band(n: Column, percent: int) -> Column:
    """The band of a size: sizes that can link lie in one band or in two side by side."""
    # a little wider than the ratio, so that rounding puts no pair two bands apart
    return F.floor(F.ln(n) / (1.001 * max(math.log(100 / percent), 1e-9)))


def _mixed(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, root, m) of the nodes whose tile holds nodes of other components in their band or beside it.

    m counts all nodes of the tile. A tile has few bands, as many as sizes have powers of the ratio.
    """
    rooted = members.select("key", "node", "n").join(found, "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("root"), _band(F.col("n"), percent).alias("band"))
    banded = rooted.groupBy("key", "band").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    tiles = banded.groupBy("key").agg(
        F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("band", F.struct("lo", "hi")))).alias("bands")).where("lo <> hi")
    near = [F.try_element_at("bands", F.col("band") + i) for i in (-1, 0, 1)]
    return rooted.join(tiles.select("key", "m", "bands"), "key").where(
        F.least(*[b["lo"] for b in near]) != F.greatest(*[b["hi"] for b in near])).select("key", "node", "n", "root", "m")


def _blocks(mixed: DataFrame, percent: int) -> DataFrame:
    """``mixed`` with the node's block ``own`` and the blocks ``others`` that it meets, itself included.

    A block's number is that of its band times 2^20, plus its number in the band. A small tile is one block.
    """
    banded = mixed.withColumn("band", _band(F.col("n"), percent))
    of_band = banded.where(F.col("m") > BLOCK).groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    bands = of_band.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))

    def numbers(band: Column) -> Column:
        return F.coalesce(F.transform(F.sequence(F.lit(1).cast("long"), F.try_element_at("bands", band)),
                                      lambda k: band * (1 << 20) + k), F.array().cast("array<long>"))

    band, large = F.col("band"), F.col("bands").isNotNull()
    own = band * (1 << 20) + 1 + F.pmod(F.xxhash64("node"), F.try_element_at("bands", band))
    return banded.join(bands, "key", "left").select(
        "key", "node", "n", "root", F.when(large, own).otherwise(0).alias("own"),
        F.when(large, F.concat(numbers(band - 1), numbers(band), numbers(band + 1))).otherwise(
            F.array(F.lit(0).cast("long"))).alias("others"))


def _crossing(mixed: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (key, a, b, score) of a tile that lie in different components and pass sizes and bitmaps.

    A pair is made by the first tile of both nodes for certain, by a later one only if the nodes' EARLIER tiles before it differ.
    ``forest``: of each two blocks only as many as connect all components that these pairs connect.
    """
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1))
    bits = F.col("bits" if forest else "fine").alias("bits")
    members = _blocks(mixed, percent).withColumn("before", before).join(nodes.select("node", bits), "node")
    dealt = members.select("key", "node", "n", "root", "before", "bits", "own", F.explode("others").alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own",
                         "node", "n", "root", "before", "bits")
    sorted_tiles = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n")

    def pairs_of(rows: dict[str, np.ndarray], group: np.ndarray):
        """Indices of passing pairs of one group, and their scores; rows are sorted by group and size."""
        n, at = rows["n"], np.arange(len(group))
        order = group * (1 << 40) + n
        after = np.searchsorted(order, group * (1 << 40) + 100 * n // percent, "right") - at - 1
        for begin, stop in _runs(after):
            i = np.repeat(at[begin:stop], after[begin:stop])
            j = np.arange(len(i)) - np.repeat(np.cumsum(after[begin:stop]) - after[begin:stop], after[begin:stop]) + i + 1
            root, block, lo, hi = (rows[c] for c in ("root", "own", "lo", "hi"))
            near = (root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
            every_i, every_j = i[near], j[near]
            lengths, folds = rows["bits"]
            words = np.minimum(lengths[every_i], lengths[every_j])
            for length, bits in folds.items():
                i, j = every_i[words == length], every_j[words == length]
                i, j, differing, sizes = _passing(bits, i, j, n[i] + n[j], percent)
                new = ~_met(rows["before"], i, j)
                yield i[new], j[new], (differing / sizes)[new]

    def compared(table: pa.Table):
        if len(table) < 2:
            return
        rows = {c: np.asarray(table.column(c).combine_chunks()) for c in ("key", "lo", "hi", "own", "node", "n", "root")}
        rows["bits"] = _folds(table.column("bits").combine_chunks())
        rows["before"] = table.column("before").combine_chunks()
        new = np.zeros(len(table), bool)
        for c in ("key", "lo", "hi"):
            new[1:] |= rows[c][1:] != rows[c][:-1]
        group = np.cumsum(new)
        found = list(pairs_of(rows, group))
        i, j, score = (np.concatenate(p) for p in zip(*found, strict=True))
        if forest and len(i):
            label = np.unique(np.stack([group, rows["root"]]), axis=1, return_inverse=True)[1].ravel()
            picked = _forest(label[i], label[j], score)
            i, j, score = i[picked], j[picked], score[picked]
        a, b = rows["node"][i], rows["node"][j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["key"][i]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score, pa.float64())],
            ["key", "a", "b", "score"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            same = np.ones(len(table), bool)
            for c in ("key", "lo", "hi"):
                values = np.asarray(table.column(c).combine_chunks())
                same &= values == values[-1]
            begin = int(np.argmax(same))  # the last group may go on in the next batch
            yield from compared(table.slice(0, begin))
            held = table.slice(begin).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return sorted_tiles.mapInArrow(run, "key long, a long, b long, score double")


def _met(before: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lists of rows i and j have a value in common, for each pair (i, j)."""
    starts, flat = np.asarray(before.offsets), np.asarray(before.values)
    found, lengths = np.zeros(len(i), bool), np.diff(starts)
    for s in range(int(lengths.max(initial=0))):
        for t in range(int(lengths.max(initial=0))):
            both = np.flatnonzero(~found & (s < lengths[i]) & (t < lengths[j]))
            found[both] = flat[starts[i[both]] + s] == flat[starts[j[both]] + t]
    return found


def _passing(bits: np.ndarray, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, percent: int):
    """Of the pairs (i, j) those whose bitmaps pass, with their differing bits and sizes.

    Words are compared in growing parts, so that most pairs end at the first.
    """
    differing, begin = np.zeros(len(i), np.int64), 0
    while begin < bits.shape[1]:
        part = slice(begin, begin := max(FIRST, 2 * begin))
        at_once = max(1, WORDS_AT_ONCE // (part.stop - part.start))
        for k in range(0, len(i), at_once):
            some = slice(k, k + at_once)
            differing[some] += np.bitwise_count(bits[i[some], part] ^ bits[j[some], part]).sum(axis=1, dtype=np.int64)
        good = (100 + percent) * (sizes - differing) >= 2 * percent * sizes
        i, j, differing, sizes = i[good], j[good], differing[good], sizes[good]
    return i, j, differing, sizes


def _runs(counts: np.ndarray):
    """Consecutive ranges whose counts add up to about COMPARED."""
    total, begin = np.cumsum(counts), 0
    while begin < len(counts):
        before = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, before + COMPARED, "right")))
        yield begin, stop
        begin = stop


class _Texts:
    """Whole texts of the nodes' first rows. Those fetched once are kept for later rounds."""

    def __init__(self, docs: DataFrame, id_column: str, text: str, scratch: Scratch):
        self.keep = scratch.keep
        row = F.xxhash64(F.col(id_column).cast("long"), F.col(text))
        self.docs, self.stored = docs.select(row.alias("row"), F.col(text).alias("text")), None

    def of(self, needed: DataFrame) -> DataFrame:
        """(row, text) of at least the rows needed."""
        if self.stored is not None:
            needed = self.keep(needed.join(self.stored.select("row"), "row", "left_anti"))
            if needed.isEmpty():
                return self.stored
        fetched = self.keep(within(self.docs, needed, "row").join(needed, "row", "left_semi").dropDuplicates(["row"]))
        self.stored = fetched if self.stored is None else self.stored.unionAll(fetched)
        return self.stored


def _verified(pairs: DataFrame, source: _Texts, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets overlap enough."""
    of, keep = nodes.select("node", "row"), source.keep
    pairs = keep(pairs.select("a", "b").join(of.select(F.col("node").alias("a"), F.col("row").alias("ra")), "a")
                 .join(of.select(F.col("node").alias("b"), F.col("row").alias("rb")), "b"))
    bodies = source.of(pairs.select(F.col("ra").alias("row")).unionAll(pairs.select("rb")).distinct())
    both = (pairs.join(bodies.select(F.col("row").alias("rb"), F.col("text").alias("tb")), "rb")
            .join(bodies.select(F.col("row").alias("ra"), F.col("text").alias("ta")), "ra"))

    def run(batches):
        before, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != before:
                    before, own = a[i], shingles(texts(ta[i:i + 1])[0], words)
                good[i] = linked(own, shingles(texts(tb[i:i + 1])[0], words), percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    return keep(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def within(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones, without a shuffle: by a broadcast of at most BUCKETS numbers."""
    of = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    return df.join(F.broadcast(wanted.select(of.alias("_bucket")).distinct()), of == F.col("_bucket"), "left_semi")


def beyond(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that ``within`` leaves out."""
    of = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    return df.join(F.broadcast(wanted.select(of.alias("_bucket")).distinct()), of == F.col("_bucket"), "left_anti")


def _nodes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node. Rows whose node occurs once, most of them, are not shuffled."""
    rows = rows.where("node is not null")
    repeated = scratch.keep(rows.groupBy("node").count().where("count > 1").select("node"))
    return beyond(rows, repeated, "node").unionAll(within(rows, repeated, "node").dropDuplicates(["node"]))


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, first, m): prefix shingles of two or more nodes, with the first of them and their number."""
    keyed = nodes.select(F.explode("prefix").alias("key"), "node")
    return keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1")


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS,
         percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, root) of every row; ``row`` is the hash of id and text.

    ``root`` names the component also where no row of it has an id; it is null without shingles.

    ``percent``: two documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    scratch = Scratch()
    rows = keep(signatures(docs, id_column, text, words, percent))
    limit = max(HEAVY, rows.count() // 1000)  # so that at most a bounded number of keys can exceed it
    alone = _nodes(rows, scratch)
    shared = scratch.keep(_shared(alone))
    heavy = [r["key"] for r in shared.where(F.col("m") > limit).select("key").collect()]
    if heavy:
        late = np.sort(np.array(heavy, np.int64).view(np.uint64))
        rows = keep(signatures(docs, id_column, text, words, percent, late))
        alone = _nodes(rows, scratch)
        shared = scratch.keep(_shared(alone))
    keyed = alone.select(F.explode("prefix").alias("key"), "node", "n")
    tiles = scratch.keep(keyed.join(shared.select("key", "first"), "key"))
    nodes = scratch.keep(alone.select("node", "n", "row", "bits", "fine"))
    source, stars = _Texts(docs, id_column, text, scratch), scratch.keep(_stars(tiles, nodes, percent))
    links = _verified(_likeliest(stars), source, nodes, words, percent)
    found, members = components(links, scratch=scratch), tiles.where("node <> first")
    for forest in (True, False):
        members, stars = scratch.keep(_mixed(members, found, percent)), scratch.keep(_parted(stars, found))
        crossing = scratch.keep(_crossing(members, nodes, percent, forest))
        pairs = (_likeliest(stars) if forest else stars.select("a", "b")).unionAll(crossing.select("a", "b")).distinct()
        links = links.unionAll(_verified(pairs, source, nodes, words, percent))
        found = components(links, scratch=scratch)
        if forest:  # a tile's pairs that may link are joined if those of its forest are
            members = members.join(_parted(crossing, found).select("key").distinct(), "key", "left_semi")
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = keep(least.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    scratch.clear()
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(of_root, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left").select(
        "doc_id", "row", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id"), "root")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the smallest id and text hash; rows alone in their group stay."""
    found = keep(join(docs, id_column, text, words, percent).where("root is not null").select("doc_id", "row", "root"))
    groups = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("m")).where("m > 1")
    members = keep(found.join(groups, "root").select("row", (F.col("row") == F.col("first.row")).alias("stays")))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(id_column).cast("long"), F.col(text)).alias("row"))
    doubtful = within(rows, members, "row")
    alone = doubtful.join(members, "row", "left_anti")
    first = doubtful.join(members.where("stays").select("row").distinct(), "row").dropDuplicates(["row"])
    return beyond(rows, members, "row").select("doc.*").unionAll(alone.select("doc.*")).unionAll(first.select("doc.*"))
