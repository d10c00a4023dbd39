"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets fall in size bands. Of two linked sets the
smaller lies in some band, whose sizes bound how many elements the two differ in, k. PartEnum deals the element domain
into groups of ``WIDE`` parts, more than k / 2 of them: some groups hold at most one difference, so of each such group's
subsets of all parts but one, one subset agrees. Each subset gives a signature, and linked sets share one, whatever their elements (no
false negatives). The groups are ``SPARE`` more than must be, so that the subsets of fewest elements need not be sent (see ``Instance.signatures``).

Equal sets are one class before any signature leaves a task. Signatures travel as packed arrays, one row for
each slice of a batch and shard. Classes that share a signature are candidates. A candidate most of whose elements no other
candidate has can't link and is out (``alive``). The others are verified on the whole sets
against a hub of their bucket. Members of a bucket that are then still in different components need not all meet: linked sets
share an element among the rarest few of each, and from the first one that they share on (rarest first) each has
as many elements as the link needs in common (``can_link``). So every link that could change a component is
tested, and few others, also in a large group of near copies with edits of their own.

Defined cases: null, empty and wordless texts have the empty set and link with nothing; a text with fewer
words than a shingle has one element, the whole sequence. A very long text is a set like any other, made in one step
of some 40 bytes of memory a byte of it. Repeated rows with one doc_id stay one row each and are each linked by their own text.
A null doc_id can't name a component: the minimum ignores it, and a component of such rows alone has a null component_id. Ties have no
effect: components don't depend on the order of rows. An empty table gives an empty table. Extra columns, whatever their names, are not read.
Shingles and classes of equal sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import SPACE_WORDS, by_shard, checkpoint, lean, mix, partitions, released, signed, slices, table, word_hashes
from usagelens.llm.components import connected_components

U = np.uint64
#: Classes whose signatures a task remembers having sent.
SEEN = 500_000
#: So many ids of candidates may be broadcast to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds of one more hub a class before what is still apart meets by its rare elements.
HUB_ROUNDS = 1
#: Elements before one, of the same set, that a pair's meeting looks back to.
BEFORE = 16
#: Parts of a group, and the share of groups beyond those that a link needs.
WIDE, SPARE = 3, 0.2
#: Signatures that a task sorts at once.
SORTED = 8 << 20


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) in slices."""
    for a, b, data, offsets in slices(column):
        rows, h, _, _ = word_hashes(data, offsets, SPACE_WORDS)
        bounds = np.searchsorted(rows, np.arange(b - a + 1))
        if len(h) >= n:
            grams = h[: len(h) - n + 1] * U(3)
            for j in range(1, n):
                grams = mix(grams) + h[j : len(h) - n + 1 + j] * U(2 * j + 3)
            grams = mix(grams)
        out = []
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= n:
                own = np.sort(grams[lo : hi - n + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            elif hi > lo:
                out.append(mix(np.array([xxhash.xxh3_64_intdigest(h[lo:hi].tobytes(), seed=int(hi - lo))], U)))
            else:
                out.append(np.zeros(0, U))
        yield a, out


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


# ---------------------------------------------------------------- PartEnum


@dataclass(frozen=True)
class Instance:
    """A PartEnum of its own: sets of at least ``lo`` elements that differ in at most ``k``.

    The domain falls in ``groups`` groups of ``WIDE`` parts. At least ``groups - k // 2`` groups hold at most one difference
    of two such sets, so in each of them one subset of ``WIDE - 1`` parts agrees.
    """

    number: int
    k: int
    groups: int
    parts: int

    @property
    def sure(self) -> int:
        """Groups of which one subset at least agrees."""
        return self.groups - self.k // 2

    def signatures(self, s: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Of a sorted set and the running sums of its elements.

        Subsets of few elements tell little and are left out, as far as that is safe: with ``least`` elements in the poorest subset
        of the ``sure``-th poorest group, one of the agreeing groups has only subsets of ``least`` or more. The subset that agrees there has as many
        elements in the other set, whose own bound, should it be lower, keeps it too.
        """
        cut = np.empty(self.parts + 1, np.int64)
        cut[:-1], cut[-1] = np.searchsorted(s, thresholds(self.parts)), len(s)
        part, size = sums[cut[1:]] - sums[cut[:-1]], cut[1:] - cut[:-1]
        part += seeds(self.number, self.parts)
        part = mix(part)
        if self.parts == 1:
            return part
        part, size = part.reshape(self.groups, WIDE), size.reshape(self.groups, WIDE)
        # A subset is named by the part that it lacks.
        made, count = part.sum(1, keepdims=True) - part, size.sum(1, keepdims=True) - size
        least = np.partition(count.min(1), self.sure - 1)[self.sure - 1]
        return made[count >= least]


@lru_cache(maxsize=1_000)
def seeds(number: int, parts: int) -> np.ndarray:
    return mix(np.arange(parts, dtype=U) + (U(number + 1) << U(40)))


@lru_cache(maxsize=10_000)
def thresholds(parts: int) -> np.ndarray:
    """The least hash of each part: parts are ranges of hashes."""
    return np.array([-(-(i << 64) // parts) for i in range(parts)], U)


@lru_cache(maxsize=1_000)
def instance(band: int, num: int, den: int) -> Instance:
    """That of the links whose smaller set lies in the band."""
    hi = bands()[band][1]
    k = (hi + max(hi, hi * den // num)) * (den - num) // (den + num)
    if k == 0:
        return Instance(band, 0, 1, 1)
    groups = k // 2 + 1
    groups += int(groups * SPARE)
    return Instance(band, k, groups, groups * WIDE)


@lru_cache(maxsize=1)
def bands() -> list[tuple[int, int]]:
    """Size bands that grow by half."""
    out, lo = [], 1
    while lo < 1 << 40:
        out.append((lo, lo * 3 // 2))
        lo = out[-1][1] + 1
    return out


@lru_cache(maxsize=100_000)
def instances(size: int, num: int, den: int) -> tuple[Instance, ...]:
    """Those that a set of ``size`` takes part in: of its own band, as the smaller set, and of lower bands that it can link with."""
    return tuple(instance(i, num, den) for i, (lo, hi) in enumerate(bands()) if lo <= size and size * num <= hi * den)


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    sums = np.zeros(len(s) + 1, U)
    np.cumsum(s, out=sums[1:])
    return np.concatenate([x.signatures(s, sums) for x in instances(len(s), num, den)])


# ---------------------------------------------------------------- packed exchanges


def packed(keys: np.ndarray, groups: np.ndarray, nodes: np.ndarray, shards: int, width: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(shard, nodes, keys of each node, keys by ``width`` low bytes): the keys of ``nodes[groups]``, a row for each shard."""
    shard = ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    keys, groups = keys[order], groups[order]
    low = keys.view(np.uint8).reshape(-1, 8)[:, :width]
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        a, b = cut[i], cut[i + 1]
        own = groups[a:b]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield i, nodes[own[first]].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), low[a:b].tobytes()


def unpacked(nodes: list[bytes], counts: list[bytes], keys: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of packed rows."""
    node = np.repeat(np.frombuffer(b"".join(nodes), U), np.frombuffer(b"".join(counts), np.uint32))
    low = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
    if width == 4:
        return low.view(np.uint32).ravel(), node
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :width] = low
    return wide.view(U).ravel(), node


# ---------------------------------------------------------------- the join


def signed_keys(keys: list[int | None]) -> pa.Array:
    return pa.array([None if k is None else k - (k >> 63 << 64) for k in keys], pa.int64())


def gathered(docs: DataFrame, n: int, num: int, den: int, id: str, text: str) -> DataFrame:
    """Two kinds of rows from one pass over the texts, told apart by ``bucket``.

    (doc_id, n_shingles, node): the class of equal sets of each document; null for empty sets.
    (bucket, hub, node): the classes that share a signature; buckets with the same members once a task.
    A signature travels as the lower six of its bytes; should two be equal so, that makes candidates to verify, no links.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    kind = docs.schema[id].dataType.simpleString()
    sent = ["shard", "nodes", "counts", "signs", "ids", "sizes", "classes"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), n):
                keys, signs, nodes = [], [], []
                for s in sets:
                    keys.append(set_hash(s) if len(s) else None)
                    if len(s) and keys[-1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(keys[-1])
                        signs.append(signatures(s, num, den))
                        nodes.append(keys[-1])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (batch.column(0)[a : a + len(sets)], pa.array([len(s) for s in sets], pa.int64()), signed_keys(keys))]
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([turn % shards], pa.int32()), none, none, none, *lists], sent)
                turn += 1
                if signs:
                    rows = list(packed(np.concatenate(signs), np.repeat(np.arange(len(signs)), [len(x) for x in signs]), np.array(nodes, U), shards, 6))
                    columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rows), x.type) for x in lists)], sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "class", "bucket", "hub", "node"]
        got, ids = [], pa.null()
        for batch in batches:
            lists = [batch.column(c).flatten() for c in ("ids", "sizes", "classes")]
            ids = lists[0].type
            if len(lists[0]):
                yield pa.RecordBatch.from_arrays([*lists, *(pa.nulls(len(lists[0]), pa.int64()) for _ in range(3))], names)
            got += [x for x in zip(*(batch.column(c).to_pylist() for c in ("nodes", "counts", "signs")), strict=True) if x[0]]
        if not got:
            return
        all_signs, all_nodes = unpacked(*zip(*got, strict=True), 6)
        del got
        done: set[int] = set()
        turns = -(-len(all_signs) // SORTED)  # so many slices by hash, so that what sorting takes stays bounded
        slot = (all_signs & U(0xFFFF)) % U(turns)
        for t in range(turns):
            sign, node = (all_signs, all_nodes) if turns == 1 else (all_signs[slot == t], all_nodes[slot == t])
            order = np.argsort(sign, kind="stable")
            sign, node = sign[order], node[order]
            ends = np.append(np.flatnonzero(sign[1:] != sign[:-1]) + 1, len(sign))
            starts = np.append(0, ends[:-1])
            made: list[tuple[int, np.ndarray]] = []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                members = np.unique(node[a:b].view(np.int64))
                if len(members) > 1 and (key := xxhash.xxh3_64_intdigest(members.tobytes())) not in done:
                    done.add(key)
                    made.append((key - (key >> 63 << 64), members))
            for i in range(0, len(made), 20_000):
                some = made[i : i + 20_000]
                sizes = [len(m) for _, m in some]
                columns = [pa.array(np.repeat(np.array([k for k, _ in some], np.int64), sizes)), pa.array(np.repeat(np.array([m[0] for _, m in some]), sizes)), pa.array(np.concatenate([m for _, m in some]))]
                yield pa.RecordBatch.from_arrays([pa.nulls(sum(sizes), ids), *(pa.nulls(sum(sizes), pa.int64()) for _ in range(2)), *columns], names)

    packed_rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(send), f"shard int, nodes binary, counts binary, signs binary, ids array<{kind}>, sizes array<long>, classes array<long>")
    return by_shard(packed_rows, shards).mapInArrow(lean(meet), f"doc_id {kind}, n_shingles long, class long, bucket long, hub long, node long")


def sets_of(docs: DataFrame, n: int, text: str) -> DataFrame:
    """(node, elements) of each document's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.array([set_hash(s) for s in sets], U))), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["node", "elements"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "node long, elements array<long>")


def alive(docs: DataFrame, n: int, num: int, den: int, text: str) -> DataFrame:
    """(node): the classes of which so many elements occur in another class of ``docs`` too that they can link with one.

    Elements travel by four bytes beside their shard; two that are equal so count as shared, which keeps a class, never drops one.
    Only counts come back to the classes.
    """
    shards = partitions(docs.sparkSession)
    names = ["shard", "nodes", "counts", "keys"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), n):
                own = [(h, s) for h, s in ((set_hash(s), s) for s in sets if len(s)) if not (h in seen or seen.add(h))]
                if own:
                    rows = list(packed(np.concatenate([s for _, s in own]), np.repeat(np.arange(len(own)), [len(s) for _, s in own]), np.array([h for h, _ in own], U), shards, 4))
                    sizes = np.array([h for h, _ in own], U), np.array([len(s) for _, s in own], np.uint32)
                    home = (sizes[0] % U(shards)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names)
                    some = np.unique(home)
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([sizes[0][home == i].tobytes() for i in some], pa.binary()), pa.array([sizes[1][home == i].tobytes() for i in some], pa.binary()), pa.nulls(len(some), pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            sizes = batch.filter(pc.is_null(batch.column("keys"))).select(["shard", "nodes", "counts"])
            if len(sizes):
                yield pa.RecordBatch.from_arrays([*sizes.columns, pa.array([True] * len(sizes))], ["shard", "nodes", "counts", "whole"])
            got += [x for x in zip(*(batch.column(c).to_pylist() for c in ("nodes", "counts", "keys")), strict=True) if x[2] is not None]
        if not got:
            return
        key, node = unpacked(*zip(*got, strict=True), 4)
        del got
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # a class may come from two tasks
        key, node = key[new], node[new]
        shared = np.append(key[1:] == key[:-1], False)
        shared[1:] |= shared[:-1]
        node, counts = np.unique(node[shared], return_counts=True)
        home = (node % U(shards)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        home, node, counts = home[order], node[order], counts[order].astype(np.uint32)
        cut = np.searchsorted(home, np.arange(shards + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for x in (node, counts)), pa.array([False] * len(full))], ["shard", "nodes", "counts", "whole"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for x in batch.to_pylist():
                got[x["whole"]].append((x["nodes"], x["counts"]))
        if not got[True] or not got[False]:
            return
        (node, size), (shared, part) = ((np.frombuffer(b"".join(x), k) for x, k in zip(zip(*got[w], strict=True), (U, np.uint32), strict=True)) for w in (True, False))
        node, first = np.unique(node, return_index=True)
        total = np.bincount(np.searchsorted(node, shared), weights=part, minlength=len(node)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(node[total * den >= size[first].astype(np.int64) * num]))], ["node"])

    counted = by_shard(docs.select(F.col(text).alias("text")).mapInArrow(lean(send), "shard int, nodes binary, counts binary, keys binary"), shards).mapInArrow(lean(count), "shard int, nodes binary, counts binary, whole boolean")
    return by_shard(counted, shards).mapInArrow(lean(settle), "node long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    # By size first: the sets then travel for fewer pairs.
    n = sets.select("node", F.size("elements").alias("n"))
    pairs = pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("p")), "a").join(n.select(F.col("node").alias("b"), F.col("n").alias("q")), "b")
    pairs = pairs.where(F.least("p", "q").cast("long") * den >= F.greatest("p", "q").cast("long") * num).select("a", "b")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(F.col("shared") * den >= (F.size("x") + F.size("y") - F.col("shared")) * num).select("a", "b")


def can_link(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: nodes of different components that may link, by (node, component). None that link are left out.

    Only elements that occur in different components count. They are ranked by how many of the nodes have them; ``left`` counts a set's
    elements from one of them on to the most common. Linked sets have num / (num + den) of their sizes' sum in common, all from their first
    shared element on, so a node with fewer such elements than a link needs is out, and each other node meets by its rarest few.
    """
    sizes = sets.select("node", F.size("elements").cast("long").alias("n")).join(nodes, "node")
    own = sets.join(nodes, "node").select("node", "component", F.explode("elements").alias("element"))
    across = own.groupBy("element").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("element", "f")
    ranked = own.join(across, "element").withColumn("left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("f"), F.desc("element"))))
    x = ranked.select("element", "node", "left").join(sizes, "node").where(F.col("left") * den >= F.col("n") * num)
    # A pair meets at the first element that it shares; of the further ones those are left out that follow within ``BEFORE`` of both sets' own.
    near = Window.partitionBy("node").orderBy(F.desc("left")).rowsBetween(-BEFORE, -1)
    x = checkpoint(x.withColumn("before", F.collect_list("element").over(near)))
    y = x.select("element", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("left").alias("left_b"), F.col("before").alias("before_b"))
    met = ~F.arrays_overlap("before", "before_b") & (F.col("node") < F.col("b")) & (F.col("component") != F.col("other")) & (F.least("left", "left_b") * (num + den) >= (F.col("n") + F.col("m")) * num)
    return x.join(y, (x["element"] == y["element"]) & met).select(F.col("node").alias("a"), "b").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: components over links of Jaccard >= num/den between sets of n-word shingles."""
    rows = checkpoint(gathered(docs, n, num, den, id, text))
    member = rows.where("bucket is null").select("doc_id", "n_shingles", "class")
    shared = checkpoint(rows.where("bucket is not null").select("bucket", "hub", "node").distinct())
    released(docs.sparkSession)  # the signatures' exchange is the largest

    def texts_of(nodes: DataFrame) -> DataFrame:
        """The documents that hold the classes' sets: the smallest of each; of classes without ids, all documents without one."""
        first = member.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
        first = checkpoint(first.join(nodes, F.col("class") == F.col("node"), "left_semi").select("first").distinct())
        return docs.join(F.broadcast(first) if first.count() <= BROADCAST_IDS else first, docs[id].eqNullSafe(first["first"]), "left_semi")

    able = checkpoint(alive(texts_of(shared.select("node").distinct()), n, num, den, text))
    sets = checkpoint(sets_of(texts_of(able), n, text).join(able, "node", "left_semi").dropDuplicates(["node"]))
    shared = shared.join(able, "node", "left_semi").select("bucket", "node")
    # A bucket's hub is the member that meets most others in all its buckets: of near copies one with few edits of its own, which links with most.
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    rank = shared.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("rank"))
    hubs = shared.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"), "h.rank")
    shared = checkpoint(shared.join(hubs, "bucket"))
    del sizes, rank, hubs
    released(docs.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        return checkpoint(verified(pairs, sets, num, den))

    # Each class against the foremost hub of its buckets, then, still apart from a hub, against one more hub a round.
    # What is left apart meets where the sets can still link: each link that could change a component is tested.
    tested = checkpoint(shared.where("hub <> node").groupBy("node").agg(F.max(F.struct("rank", "hub")).alias("h")).select(F.col("h.hub").alias("a"), F.col("node").alias("b")))
    links = verify(tested)
    parts = connected_components(links)
    for last in [*[False] * HUB_ROUNDS, True]:
        placed = shared.join(parts, "node", "left").select("bucket", "hub", "rank", "node", F.coalesce("component", "node").alias("component"))
        apart = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        placed = placed.join(apart, "bucket", "left_semi")
        if last:
            open_nodes = checkpoint(placed.select("node", "component").distinct())
            rest = can_link(open_nodes, sets, num, den)
        else:
            heads = placed.where("hub = node").select("bucket", F.col("component").alias("other"))
            rest = placed.join(heads, "bucket").where("component <> other").select(F.col("hub").alias("a"), F.col("node").alias("b"), "rank")
        rest = rest.join(tested, ["a", "b"], "left_anti")
        rest = checkpoint(rest if last else rest.groupBy("b").agg(F.max(F.struct("rank", "a")).alias("h")).select("h.a", "b"))
        if rest.isEmpty():
            continue
        more = verify(rest)
        tested = tested.unionAll(rest)
        if not more.isEmpty():
            links = links.unionAll(more)
            parts = connected_components(links)
    label = member.join(parts, member["class"] == parts["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("label"))
    lowest = label.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return label.join(lowest, "label", "left").select(F.col("doc_id").alias(id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
