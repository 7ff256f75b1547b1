"""Operator 3: exact Jaccard join of word-shingle sets by T-occurrence search.

A pair links when its common shingles reach T = t / (1 + t) x (both sizes).

Bringing together whatever may link.  Sets of like size are cut by hash into
k segments, k above the most shingles a linked pair can differ in, so a linked
pair has a whole segment in common (pigeonhole).  Only 64-bit digests of
segments are shuffled.  Sizes form bands; a set near the upper end of its band
takes part in the next band too.  Empty segments say nothing and are left out
where k leaves enough full ones; a set with too many empty ones sends them all.
The smallest set of a digest is its pivot, and a pivot with all sets that meet
it is one group.  Two things keep this small.  Digests are counted first, and a
Bloom filter of fixed size tells later which ones are worth a row.  And a set
leaves a group in which no other is near it by size and by a 128-byte parity
sketch, which never exceeds the true difference.

Searching.  In a group, DivideSkip answers "who reaches T with this set": the
longest inverted lists are put aside, the short ones are merged with a heap,
and only what occurs often enough there is looked up in the long ones by binary
search.  From each set found the search goes on among sets not yet reached, so
a cluster of near copies is walked once and no pair is listed twice.

Large groups are dealt to blocks of about ``BLOCK`` shingles, each with the
pivot.  What the pivot's component doesn't reach in its own block is then
searched in all blocks of the group, so no link is lost.

Equal sets are one node throughout (64-bit digest of the set), however many
documents have it; shared passages make long lists, which are only probed.

Defined cases.  Null texts and texts without words have the empty set, size 0,
and link with nothing; fewer words than ``words`` are one shingle.  Rows
with a null id link like any other and get the smallest id reachable, null where
no linked row has one.  Rows of one id are one document where components are named.  Repeated rows and ties need nothing special.  Empty table: no rows.
Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import only, stored
from crease.llm.graph import components

BAND = 1.25  # largest over smallest size in a band
ROOM = 3  # standard deviations of the number of empty segments that segments leave room for
BLOCK = 1_000_000  # shingles searched by one task
BROADCAST_ROWS = 1_000_000  # node list that may be broadcast (8 MB); a longer one is shuffled
ROWS_OUT = 100_000
SKETCH_BITS = 1024
FILTER_BITS = 26  # a Bloom filter of 2**26 bits (8 MB) whatever the input
SLICES = 128  # parts in which it is put together
PRUNED = 20_000  # members of a group that sketches are compared for; a larger group is searched whole
LIST_COST = 0.0085  # DivideSkip's weight of a lookup in a long list

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd
TEXT_BLOCK = 1 << 20  # bytes of a text worked on at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def letter_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, dtype=U64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=U64))
    return out[0], out[1]


def _block_words(data: np.ndarray) -> np.ndarray:
    """Digest of each word: its letters' values at rising powers, from power 0 wherever the word stands."""
    solid = ~BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(1 << max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(letter_values()[data] * power[: len(data)], out=sums[1:])
    word = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(word + U64(BASE) * (ends - starts).astype(U64))


def word_digests(text: bytes) -> np.ndarray:
    """64-bit digests of a text's words in order, worked out block by block."""
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    if len(data) <= TEXT_BLOCK:
        return _block_words(data)
    found, at = [], 0
    while at < len(data):
        end = at + TEXT_BLOCK
        while end < len(data) and not BLANK[data[end]]:  # to the end of the word
            solid = ~BLANK[data[end : end + TEXT_BLOCK]]
            end += len(solid) if solid.all() else int(solid.argmin())
        found.append(_block_words(data[at:end]))
        at = end
    return np.concatenate(found)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit digests of a text's distinct word shingles."""
    word = word_digests(text)
    if not len(word):
        return np.empty(0, dtype=U64)
    n = min(words, len(word))
    found = np.zeros(len(word) - n + 1, dtype=U64)
    for k in range(n):
        found = mix(found * U64(0xD6E8FEB86659FD93) + word[k : len(word) - n + 1 + k])
    return np.unique(found + U64(n))


def set_digest(found: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    sums = np.stack([found, mix(found + U64(1))]).sum(axis=1, dtype=U64)
    mixed = mix(sums + U64(len(found)))
    return int(mix(mixed[:1] ^ (mixed[1:] << U64(1))).view(np.int64)[0])


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 1024 cells.  Two sets differ in at least as many shingles as
    their sketches differ in bits."""
    cells = np.bincount((mix(found + U64(7)) >> U64(54)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def has_partner(sizes: np.ndarray, sketches: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets may link with another one, judged by sizes and sketches (rows of 64-bit numbers)."""
    n = len(sizes)
    out = np.zeros(n, dtype=bool)
    step = max(1, 2_000_000 // (n * sketches.shape[1]))
    for at in range(0, n, step):
        rows = slice(at, at + step)
        differ = np.bitwise_count(sketches[rows, None, :] ^ sketches[None]).sum(axis=2, dtype=np.int64)
        near = differ * (den + num) <= (den - num) * (sizes[rows, None] + sizes[None])
        near &= np.minimum(sizes[rows, None], sizes[None]) * den >= np.maximum(sizes[rows, None], sizes[None]) * num
        out[rows] = near.sum(axis=1) > 1
    return out


# -- segments


class Bands:
    """Size bands and their numbers of segments for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops, self.counts = num, den, [1], {}

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))
        return bisect_left(self.tops, n)

    def differ(self, b: int) -> int:
        """Most shingles in which a linked pair of sizes up to the band's top can differ."""
        return (self.den - self.num) * 2 * self.tops[b] // (self.den + self.num)

    def segments(self, b: int) -> int:
        """One more than can differ, and room for the empty segments of nearly all sets that take part."""
        if b not in self.counts:
            low = max(1, (self.tops[b - 1] + 1) * self.num // self.den) if b else 1  # also from the band below
            least = self.differ(b) + 1
            k = least
            for _ in range(12):
                empty = k * np.exp(-low / k)
                k = min(least + ceil(empty + ROOM * empty**0.5), 2 * least + 1)
            self.counts[b] = k
        return self.counts[b]

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n takes part."""
        b = self.band(n)
        larger = n * self.den // self.num  # the largest set that can link with it
        return [b, b + 1] if self.band(larger) > b else [b]


def signatures(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Digests of the segments that a set shares with every set it links to, at least one with each."""
    out = []
    for b in bands.of(len(found)):
        bands.band(bands.tops[-1] + 1) if b >= len(bands.tops) else None
        k = bands.segments(b)
        scrambled = mix(found + U64(2 * b + 1))
        segment = ((scrambled >> U64(32)) * U64(k)) >> U64(32)
        sums = np.zeros(k, dtype=U64)
        np.add.at(sums, segment.astype(np.int64), scrambled)
        full = np.zeros(k, dtype=bool)
        full[segment.astype(np.int64)] = True
        digest = mix(mix(sums) + np.arange(k, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(b))
        room = k - bands.differ(b) - 1
        out.append(digest if np.count_nonzero(~full) > room else digest[full])
    return np.concatenate(out)


# -- T-occurrence search


class Index:
    """Inverted lists of some sets, whose numbers come in rising order."""

    def __init__(self, sets: list[np.ndarray], members: list[int]):
        every = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.array(members, dtype=np.int64), [len(sets[i]) for i in members])
        order = np.argsort(every, kind="stable")
        self.tokens, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.owners = owner[order]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)] if len(at) and at[-1] >= len(self.tokens) else at
        at = at[self.tokens[at] == query[: len(at)]]
        return [self.owners[a:b].tolist() for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist())]


def search(index: Index, sets: list[np.ndarray], query: np.ndarray, num: int, den: int) -> list[int]:
    """Members whose overlap with ``query`` makes a similarity of at least num / den (DivideSkip)."""
    n = len(query)
    least = -(-num * n // den)  # overlap with the smallest set that can link
    lists = index.lists(query)
    if len(lists) < least:
        return []
    lists.sort(key=len)
    aside = min(least - 1, int(least / (LIST_COST * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = []
    for member, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        size = len(sets[member])
        need = max(least, -(-num * (n + size) // (num + den)))
        if count + len(long) < need:
            continue
        for k, listed in enumerate(long):
            if count >= need or count + len(long) - k < need:
                break
            at = bisect_left(listed, member)
            count += at < len(listed) and listed[at] == member
        if count >= need:
            found.append(member)
    return found


def walk(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Component of each set, named by its first member; each search covers sets not reached so far."""
    label = [-1] * len(sets)
    rest = list(range(len(sets)))
    index, indexed = Index(sets, rest), len(rest)
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root], queue = root, [root]
        while queue:
            if not rest:
                break
            query = sets[queue.pop()]
            new = [i for i in search(index, sets, query, num, den) if label[i] < 0]
            for i in new:
                label[i] = root
            queue += new
            rest = [i for i in rest if label[i] < 0] if new or label[rest[0]] >= 0 else rest
            if len(rest) * 2 < indexed and rest:
                index, indexed = Index(sets, rest), len(rest)
    return label


# -- on Spark


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [np.asarray(x.values).view(U64) for x in column]


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(_id, _n, _node, _sketch) and carried columns: size, digest and sketch of every row's set."""
    carried = [c for c in docs.columns if c not in ("_id", "_text")]
    schema = T.StructType(
        [
            docs.schema["_id"],
            T.StructField("_n", T.LongType()),
            T.StructField("_node", T.LongType()),
            T.StructField("_sketch", T.BinaryType()),
            *[docs.schema[c] for c in carried],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, node, marks = [], [], []
            for text in batch.column("_text"):
                found = shingles(text.as_buffer().to_pybytes(), words) if text.is_valid else np.empty(0, dtype=U64)
                n.append(len(found))
                node.append(set_digest(found) if len(found) else None)
                marks.append(sketch(found) if len(found) else None)
            columns = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(marks, pa.binary())]
            columns += [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated_filter(repeated: DataFrame) -> np.ndarray:
    """Bloom filter of the digests (_sig), of a fixed size, put together in slices."""
    place = F.shiftrightunsigned("_sig", 64 - FILTER_BITS)
    width = (1 << FILTER_BITS) // SLICES
    bits = repeated.select((place / width).cast("long").alias("slice"), (place % width).alias("bit")).distinct()

    def build(group: pa.Table) -> pa.Table:
        marks = np.zeros(width, dtype=np.uint8)
        marks[np.asarray(group["bit"])] = 1
        return pa.table({"slice": group["slice"][:1], "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = np.zeros((SLICES, width // 8), dtype=np.uint8)
    for r in bits.groupBy("slice").applyInArrow(build, "slice long, marks binary").toLocalIterator():  # 128 rows of 64 kB
        out[r["slice"]] = np.frombuffer(r["marks"], dtype=np.uint8)
    return out.ravel()


def signature_rows(docs: DataFrame, words: int, num: int, den: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(_sig, _node): the digests of every row's segments; of those in the filter, if one is given."""
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([T.StructField("_sig", T.LongType()), T.StructField("_node", T.LongType())])

    def emit(sigs: list, nodes: list) -> pa.RecordBatch:
        sig = np.concatenate(sigs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate(nodes))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]):
        bands = Bands(num, den)
        for batch in batches:
            sigs, nodes, n = [], [], 0
            for text in batch.column("_text"):
                found = shingles(text.as_buffer().to_pybytes(), words) if text.is_valid else ()
                if not len(found):
                    continue
                own = signatures(found, bands)
                if shared is not None:
                    place = own >> U64(64 - FILTER_BITS)
                    own = own[(shared.value[(place >> U64(3)).astype(np.int64)] >> (U64(7) - (place & U64(7))).astype(np.uint8)) & 1 > 0]
                sigs.append(own)
                nodes.append(np.full(len(sigs[-1]), set_digest(found), dtype=np.int64))
                n += len(sigs[-1])
                if n >= ROWS_OUT:
                    yield emit(sigs, nodes)
                    sigs, nodes, n = [], [], 0
            if n:
                yield emit(sigs, nodes)

    return docs.select("_text").mapInArrow(run, schema)


def near_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, node) of members (pivot, node, size, sketch) that may link with another one of their group.

    A group's pivot is then the smallest that is left."""
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("_members"))
    counted = members.join(sizes, "pivot")

    def prune(group: pa.Table) -> pa.Table:
        nodes = np.asarray(group["node"])
        sketches = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=U64).reshape(len(nodes), -1)
        left = nodes[has_partner(np.asarray(group["size"]), sketches, num, den)]
        return pa.table({"pivot": np.full(len(left), left.min(initial=np.iinfo(np.int64).max)), "node": left})

    few = counted.where(F.col("_members") <= PRUNED).drop("_members").groupBy("pivot").applyInArrow(prune, "pivot long, node long")
    return few.union(counted.where(F.col("_members") > PRUNED).select("pivot", "node")).distinct()


def node_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, size, shingles) of the given nodes, from one document each."""
    named = F.struct(F.col("_id").isNull().alias("_last"), "_id", "_text_key")  # a row with an id, where there is one
    one = rows.join(nodes.withColumnRenamed("node", "_node"), "_node", "left_semi").groupBy("_node").agg(F.min(named).alias("_one"))
    one = stored(one.select(F.col("_one._id").alias("_wanted"), F.col("_one._text_key").alias("_wanted_key")).distinct(), "jaccard-wanted")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    schema = T.StructType(
        [
            T.StructField("node", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("shingles", T.ArrayType(T.LongType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for big in batches:
            for at in range(0, big.num_rows, 500):
                found = [shingles(t.as_buffer().to_pybytes(), words) for t in big.column("_text").slice(at, 500) if t.is_valid]
                found = [x for x in found if len(x)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([set_digest(x) for x in found], pa.int64()),
                            pa.array([len(x) for x in found], pa.int64()),
                            pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                        ],
                        names=schema.names,
                    )

    same = F.col("_id").eqNullSafe(F.col("_wanted")) & (F.col("_text_key") == F.col("_wanted_key"))
    return docs.join(one, same, "left_semi").select("_text").mapInArrow(run, schema).dropDuplicates(["node"])


LABELS = T.StructType([T.StructField(c, T.LongType()) for c in ("pivot", "block", "node", "label")])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def walk_blocks(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Components inside each (pivot, block); a component with the pivot bears its name, others their smallest node's."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group["node"]), kind="stable")
        group = group.take(pa.array(order))
        nodes, pivot = np.asarray(group["node"]), group["pivot"][0].as_py()
        names = nodes[walk(_arrays(group["shingles"]), num, den)]
        names[names == names[np.flatnonzero(nodes == pivot)[0]]] = pivot
        return pa.table({"pivot": group["pivot"], "block": group["block"], "node": nodes, "label": names})

    return blocks.groupBy("pivot", "block").applyInArrow(run, LABELS)


def search_blocks(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the searched sets of another block and the sets of this one, by their labels."""

    def run(group: pa.Table) -> pa.Table:
        asks, sets = np.asarray(group["asks"]), _arrays(group["shingles"])
        labels = np.asarray(group["label"])
        home, asking = np.flatnonzero(~asks).tolist(), np.flatnonzero(asks).tolist()
        links = set()
        if home and asking:
            index = Index(sets, home)
            for q in asking:
                links |= {(int(labels[q]), int(labels[i])) for i in search(index, sets, sets[q], num, den)}
        found = sorted(x for x in links if x[0] != x[1])
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return pairs.groupBy("pivot", "block", "part").applyInArrow(run, LINKS)


def jaccard_components(
    df: DataFrame,
    doc_id: str,
    text: str,
    words: int = 5,
    num: int = 8,
    den: int = 10,
    keep: Sequence[str] = (),
    block: int = BLOCK,
    group: str | None = None,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and columns ``keep`` of every row.

    ``group`` names a further column: a number that exactly the rows linked with each other
    share, whether they have ids or not (null for rows without shingles)."""
    kept = [f"_k{i}" for i in range(len(keep))]
    every = only(df, doc_id, text, *keep).toDF("_id", "_text", *kept).withColumn("_text_key", F.xxhash64("_text"))
    rows = stored(set_rows(every, words), "jaccard-sets")
    docs = every.select("_id", "_text", "_text_key")
    sigs = signature_rows(docs, words, num, den)

    repeated = sigs.groupBy("_sig").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    wanted = repeated_filter(repeated.select("_sig"))
    hits = stored(signature_rows(docs, words, num, den, wanted), "jaccard-hits")
    met = hits.groupBy("_sig").agg(F.min("_node").alias("pivot"), F.max("_node").alias("_last"))
    met = met.where("pivot <> _last").drop("_last")
    meets = stored(hits.join(met, "_sig").select("pivot", F.col("_node").alias("node")).distinct(), "jaccard-meets")
    marks = rows.where("_node is not null").groupBy(F.col("_node").alias("node")).agg(
        F.first("_n").alias("size"), F.first("_sketch").alias("sketch")
    )
    meets = stored(near_members(meets.join(marks, "node"), num, den), "jaccard-near")

    sets = stored(node_sets(docs, rows, meets.select("node").distinct(), words), "jaccard-node-sets")
    members = meets.join(sets.select("node", "size"), "node")
    blocks_of = members.groupBy("pivot").agg(F.ceil(F.sum("size") / F.lit(block)).cast("long").alias("blocks"))
    own = members.join(blocks_of, "pivot").select(
        "pivot", "blocks", "node", F.pmod(F.xxhash64("pivot", "node"), F.col("blocks")).alias("block")
    )
    everywhere = own.where("blocks > 1 and node = pivot").select(
        "pivot", "blocks", "node", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")
    )
    placed = stored(own.where("blocks = 1 or node <> pivot").unionByName(everywhere), "jaccard-blocks")
    labels = stored(walk_blocks(placed.drop("blocks").join(sets, "node"), num, den), "jaccard-labels")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))

    split = placed.where("blocks > 1")
    if not split.isEmpty():
        known = split.join(labels, ["pivot", "block", "node"])
        beyond = known.where("label <> pivot").join(sets.select("node", "size"), "node")
        parts = beyond.groupBy("pivot").agg(F.ceil(F.sum("size") / F.lit(block)).cast("long").alias("parts"))
        asking = beyond.join(parts, "pivot").select(
            "pivot",
            "node",
            "label",
            F.pmod(F.xxhash64("node", "pivot"), F.col("parts")).alias("part"),
            F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
            F.col("block").alias("_own"),
        )
        asking = asking.where("block <> _own").drop("_own").withColumn("asks", F.lit(True))
        home = known.join(parts, "pivot").select(
            "pivot", "node", "label", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "block"
        )
        both = asking.unionByName(home.withColumn("asks", F.lit(False)), allowMissingColumns=True)
        links = links.union(search_blocks(both.join(sets, "node"), num, den))

    reached = components(links)
    least = rows.where("_node is not null").groupBy("_node").agg(F.min("_id").alias("_least"))
    named = least.join(reached.withColumnRenamed("node", "_node"), "_node", "left")
    named = named.withColumn("_group", F.coalesce("component", "_node"))
    smallest = named.groupBy("_group").agg(F.min("_least").alias("_component"))
    by_node = named.join(smallest, "_group").select("_node", "_component", "_group")
    out = rows.join(by_node, "_node", "left")
    component = F.coalesce("_component", "_id")
    return out.select(
        F.col("_id").alias(doc_id),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        *([F.col("_group").alias(group)] if group else []),
        *[F.col(k).alias(name) for k, name in zip(kept, keep, strict=True)],
    )
