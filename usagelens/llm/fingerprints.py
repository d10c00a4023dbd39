"""Document fingerprints by a randomised edit embedding.

All texts walk the same random walk: at step j the character under a text's pointer is written out, and a
random function of (j, character) says whether the pointer moves on. Texts a few edits apart fall back into
step, so their walks differ in few places: edit distance becomes Hamming distance. A fingerprint has ``SLOTS``
bytes; slot t samples the walk at the position below twice the text's length that has the least value of hash
function t, so texts of near length sample mostly the same positions, and holds a byte of the ``SPAN`` steps there and
of where that is. The share of equal bytes is the likeness. Bands of ``WIDTH`` bytes find near fingerprints, which are verified by their
likeness (``near_components``): 0.9 of texts are found with 1 % of their characters edited, 0.95 with 0.5 %, 0.76 with 2 %.

The walks of a batch go in step with each other, an array operation a step, over whole texts.

Defined cases: null is empty; the empty text's fingerprint is all zeros. Equal texts have equal fingerprints.
Rows of equal id follow each other in the order of a hash of their texts; null ids come last, and ids that aren't integers go by their own order.
A very long text takes its steps alone once the others of its batch are done. Extra columns are not
read. An empty table gives an empty table; the next document of a lone row is that row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import by_shard, checkpoint, lean, mix, numbered, partitions, released, table
from usagelens.llm.components import connected_components
from usagelens.llm.jaccard import packed, unpacked

U = np.uint64
SLOTS = 128
STEPS = 8192  # after so many steps the random functions come again
CHARS = 8 << 20  # of a batch of walks: all take their steps together, so many lanes share the cost of a step
SPAN = 4  # steps that a slot looks at
PART_BITS = 3  # of each byte that tell apart fingerprints which share a band by chance
WIDTH, NEAR = 4, 0.25  # bytes of a band; the share of equal bytes from which two fingerprints link
#: Rows of groups that may be broadcast.
BROADCAST_ROWS = 500_000
LEAST_ID = -(1 << 63)


def _moves() -> np.ndarray:
    bits = np.unpackbits((mix(np.arange(STEPS * 4, dtype=U) + U(0xE17)).view(np.uint8)))[: STEPS * 256].reshape(STEPS, 256).copy()
    bits[:, 0] = 0  # the end of a text stays
    return bits


class Embedding:
    def __init__(self):
        self.moves = _moves()
        self.known = 0
        self.records: list[list[tuple[int, int]]] = [[] for _ in range(SLOTS)]  # (position, value), values falling
        self.where: list[np.ndarray] = []

    def grow(self, n: int) -> None:
        """Know each slot's least positions up to n."""
        while self.known < n:
            a, b = self.known, max(4096, 2 * self.known)
            j = np.arange(a, b, dtype=U)
            for t in range(SLOTS):
                v = mix(j + U((t + 1) << 40))
                best = self.records[t][-1][1] if self.records[t] else 2**64 - 1
                running = np.minimum.accumulate(v)
                for i in np.flatnonzero((v == running) & (np.append(True, running[1:] < running[:-1]))):
                    if int(v[i]) < best:
                        best = int(v[i])
                        self.records[t].append((a + int(i), best))
            self.known = b
            self.where = [np.array([p for p, _ in r]) for r in self.records]

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of SLOTS bytes for each text."""
        n = np.array([len(x) for x in texts], np.int64)
        out = np.zeros((len(texts), SLOTS), np.uint8)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        if not len(order):
            return out
        size = n[order]
        code = np.frombuffer("\0".join([texts[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = (code.astype(U) * U(0x9E3779B97F4A7C15) >> U(40)).astype(np.uint32) % np.uint32(255) + np.uint32(1)
        flat = flat.astype(np.uint8)
        first = np.cumsum(size + 1) - size - 1
        flat[first + size] = 0  # one after each text
        total = 2 * size + SPAN  # steps of each walk
        active = len(size) - np.searchsorted(total[::-1], np.arange(total[0]), "right")
        base = np.append(0, np.cumsum(active))
        trace = np.empty(base[-1], np.uint8)
        at, bit = first.copy(), np.empty(len(size), np.uint8)
        bounds = base.tolist()
        for j in range(int(total[0])):
            a, b = bounds[j], bounds[j + 1]
            c = b - a
            row = trace[a:b]
            flat.take(at[:c], out=row, mode="clip")
            self.moves[j % STEPS].take(row, out=bit[:c], mode="clip")
            at[:c] += bit[:c]
        self.grow(int(total[0]))
        lane = np.arange(len(size))
        for t in range(SLOTS):
            w = self.where[t]
            p = w[np.searchsorted(w, 2 * size, "left") - 1]
            seen = (p * 101).astype(np.uint32)
            for i in range(SPAN):
                seen = (seen ^ trace[base[p + i] + lane]) * np.uint32(0x01000193)
            out[order, t] = (seen >> np.uint32(16)).astype(np.uint8)
        return out


_own: list[Embedding] = []


def embedding() -> Embedding:
    if not _own:
        _own.append(Embedding())
    return _own[0]


def fingerprinted(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for each row; the fingerprint as SLOTS bytes."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in cuts([len(t) for t in texts]):
                rows = embedding().fingerprints(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "n_chars", "fingerprint"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), f"id {kind}, n_chars long, fingerprint binary").withColumnRenamed("id", id)


def cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > CHARS:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def buckets_of(prints: DataFrame, width: int = WIDTH) -> DataFrame:
    """(bucket, node): the distinct fingerprints (node, fingerprint) that agree in all bytes of a band of ``width``; buckets with the same members once a shard.

    A band's key travels as six bytes of its hash beside its shard; should two be equal so, that makes candidates to verify, no links.
    """
    shards, bands = partitions(prints.sparkSession), SLOTS // width

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = [(n, f) for n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not (n in seen or seen.add(n))]
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                bytes_ = np.frombuffer(b"".join(f for _, f in rows), np.uint8).reshape(len(rows), SLOTS)[:, : bands * width].reshape(len(rows), bands, width)
                keys = np.zeros((len(rows), bands), U)
                for i in range(width):
                    keys = keys << U(8) | bytes_[:, :, i].astype(U)
                signs = mix(mix(keys) + (np.arange(bands, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
                got = list(packed(signs.ravel(), np.repeat(np.arange(len(rows)), bands), np.array([n for n, _ in rows], np.int64).view(U), shards, 6))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), *(pa.array([g[i] for g in got], pa.binary()) for i in (1, 2, 3))], ["shard", "nodes", "counts", "signs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("nodes", "counts", "signs")), strict=True)]
        if not got:
            return
        sign, node = unpacked(*zip(*got, strict=True), 6)
        order = np.lexsort((node, sign))
        sign, node = sign[order], node[order]
        new = np.append(True, (sign[1:] != sign[:-1]) | (node[1:] != node[:-1]))
        sign, node = sign[new], node[new].view(np.int64)
        starts = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        ends = np.append(starts[1:], len(sign))
        done: set[int] = set()
        made: list[tuple[int, np.ndarray]] = []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            if (key := xxhash.xxh3_64_intdigest(node[a:b].tobytes())) not in done:
                done.add(key)
                made.append((key - (key >> 63 << 64), node[a:b]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([k for k, _ in made], np.int64), [len(m) for _, m in made])), pa.array(np.concatenate([m for _, m in made]))], ["bucket", "node"])

    rows = prints.select("node", "fingerprint").mapInArrow(lean(send), "shard int, nodes binary, counts binary, signs binary")
    return by_shard(rows, shards).mapInArrow(lean(meet), "bucket long, node long").distinct()


def near_components(prints: DataFrame, width: int = WIDTH, threshold: float = NEAR) -> DataFrame:
    """(node, component) of the fingerprints (node, fingerprint) that link with another.

    Fingerprints that share a band link if ``threshold`` or more of their bytes agree. Each is verified against the foremost hub of its buckets first, one
    pair a fingerprint. Where a bucket's members are then of different components, its foremost, the first eight members, then 64 and so on meet the members
    after them that are of other components: no link between members of a bucket is left out that could join two, and the rounds grow with the
    logarithm of a bucket's size.
    """
    open_ = checkpoint(buckets_of(prints, width))
    cards = checkpoint(prints.select("node", "fingerprint").join(open_.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    # A bucket's members in the order of how many others they meet in all their buckets: the foremost, of near copies one with few edits of its own,
    # links with most. It meets all others first; it comes from partial maxima, as a bucket may hold a third of all rows.
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    rank = open_.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("rank"))
    open_ = checkpoint(open_.join(rank, "node").select("bucket", "node", "rank"))
    del sizes, rank
    released(prints.sparkSession)
    # Hubs follow each other by rank, so these pairs are a forest: at most one for each fingerprint, however many bands it shares.
    hubs = open_.groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("h"))
    pairs = open_.join(hubs, "bucket").where("node <> h.node").groupBy(F.col("node").alias("b")).agg(F.max("h").alias("h")).select(F.col("h.node").alias("a"), "b")

    def beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
        x, y = (of.select(F.col("node").alias(n), F.col(of.columns[1]).alias(f)) for n, f in (("a", "x"), ("b", "y")))
        return pairs.join(y, "b").join(x, "a")

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are near. Most share a band by chance: parts of their bytes tell them apart, and whole fingerprints travel for the others only."""
        of_parts = cards.select("node", F.pandas_udf(parts_of, "binary")("fingerprint").alias("parts"))
        may = checkpoint(beside(pairs, of_parts).where(F.pandas_udf(likeness_of_parts, "double")("x", "y") >= threshold).drop("x", "y"))
        nodes = may.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = cards.join(F.broadcast(nodes) if 2 * may.count() <= BROADCAST_ROWS else nodes, "node", "left_semi")
        return checkpoint(beside(may, own).where(F.pandas_udf(likeness, "double")("x", "y") >= threshold).drop("x", "y"))

    def apart(rows: DataFrame) -> DataFrame:
        """Those of buckets whose members are of several components."""
        several = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        return rows.join(several, "bucket", "left_semi")

    tested = checkpoint(pairs)
    del pairs, hubs
    parts = connected_components(verify(tested))
    placed = open_.join(parts, "node", "left").select("bucket", "node", "rank", F.coalesce("component", "node").alias("component"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("rank"), F.desc("node")))
    open_, hubs = checkpoint(apart(placed).select("bucket", "node", "component", place.alias("place"))), 1
    merged = None
    while not open_.isEmpty():
        first = open_.where(F.col("place") <= hubs).select("bucket", F.col("node").alias("hub"), F.col("component").alias("other"), F.col("place").alias("before"))
        met = open_.join(first, (open_["bucket"] == first["bucket"]) & (F.col("place") > F.col("before")) & (F.col("component") != F.col("other")))
        met = met.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.min("other").alias("other"), F.min("component").alias("own"))
        found = verify(met.join(tested.select("a", "b"), ["a", "b"], "left_anti") if hubs == 1 else met).select("other", "own").distinct()
        left = open_.where(F.col("place") > hubs)
        if not found.isEmpty():
            # Whose components have linked goes by the joint one from now on, so that fewer of what is left need to meet.
            to = checkpoint(connected_components(found, "other", "own").select(F.col("node").alias("component"), F.col("component").alias("to")))
            left = left.join(to, "component", "left").select("bucket", "node", F.coalesce("to", "component").alias("component"), "place")
            joint = to.select(F.col("component").alias("a"), F.col("to").alias("b")).where("a <> b")
            merged = joint if merged is None else merged.unionAll(joint)
        open_ = checkpoint(apart(left))
        hubs *= 8
    return parts if merged is None else connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(merged))


def grouped(rows: DataFrame, id: str = "doc_id", width: int = WIDTH, threshold: float = NEAR) -> DataFrame:
    """The rows (.., id, fingerprint) with ``group_id``, the least id of those with near fingerprints; equal fingerprints are one from the start.

    Groups of one row are not joined: the others are broadcast while they are few (``BROADCAST_ROWS``), else joined by a shuffle.
    """
    rows = checkpoint(rows.withColumn("node", F.xxhash64("fingerprint")))
    released(rows.sparkSession)  # the texts' exchange is the largest
    parts = near_components(rows.select("node", "fingerprint"), width, threshold)
    named, label = rows.select("node", F.col(id).alias("id")).join(parts, "node", "left"), F.coalesce("component", "node")
    # A row for each task's fingerprints, then for each label: a group of copies with a third of all rows is pre-aggregated.
    named = named.groupBy("node", label.alias("label")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    least = named.groupBy("label").agg(F.min("id").alias("least"), F.sum("n").alias("n")).where("n > 1").select("label", "least")
    to = checkpoint(named.join(least, "label").select(F.col("node").alias("of"), "least"))
    found = rows.join(F.broadcast(to) if to.count() <= BROADCAST_ROWS else to, rows["node"] == to["of"], "left")
    return found.withColumn("group_id", F.coalesce("least", F.col(id))).drop("node", "of", "least")


def near_groups(prints: DataFrame, width: int = WIDTH, threshold: float = NEAR, id: str = "doc_id") -> DataFrame:
    """(id, group): documents (id, fingerprint) with near fingerprints, linked over all pairs that share a band."""
    return grouped(prints.select(id, "fingerprint"), id, width, threshold).select(id, F.col("group_id").alias("group"))


def parts_of(fingerprint: pd.Series) -> pd.Series:
    """The low three bits of each byte, packed: they are equal where the bytes are."""
    if not len(fingerprint):
        return pd.Series([], dtype=object)
    low = np.frombuffer(b"".join(fingerprint), np.uint8).reshape(len(fingerprint), -1, 1) << np.uint8(8 - PART_BITS)
    return pd.Series([r.tobytes() for r in np.packbits(np.unpackbits(low, axis=2)[:, :, :PART_BITS].reshape(len(low), -1), axis=1)])


def likeness_of_parts(x: pd.Series, y: pd.Series) -> pd.Series:
    """The share of equal parts, no less than that of equal bytes."""
    if not len(x):
        return pd.Series([], dtype=float)
    a, b = (np.unpackbits(np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1), axis=1).reshape(len(c), -1, PART_BITS) for c in (x, y))
    return pd.Series((a == b).all(2).mean(1))


def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
    """The share of equal bytes of two columns of fingerprints."""
    if not len(x):
        return pd.Series([], dtype=float)
    a, b = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (x, y))
    return pd.Series((a == b).mean(1))


# ---------------------------------------------------------------- a document, its edited text and the next


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, own, key, id, tie, text): ranges of ids by buckets, a partition each, in descending order; the row after a bucket's last comes as its guest.

    The driver holds a split point and a largest id for each partition. Each text is exchanged once, compressed.
    """
    spark = df.sparkSession
    n = partitions(spark)
    if df.schema[id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        key = F.coalesce(F.col(id).cast("long"), F.lit(LEAST_ID))
    else:
        df, name, _ = numbered(df.select(id, text), id, text)
        key = F.col(name)
    rows = df.select(key.alias("key"), F.col(id).alias("id"), F.col(text).alias("text"))
    splits = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    splits = np.array(sorted(set(splits or [])), np.int64)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, key.to_numpy(np.int64)).astype(np.int32))

    largest = sorted((r[0], r[1]) for r in rows.select("key").withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.max("key")).collect())
    guests: dict[int, list[int]] = {}
    for i, (b, _) in enumerate(largest):
        guests.setdefault(largest[i - 1][1], []).append(b)  # of the lowest: the largest of all

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            own, texts = np.searchsorted(splits, keys).tolist(), batch.column("text").cast(pa.binary()).to_pylist()
            at, to = list(range(len(batch))), own[:]
            for i, k in enumerate(keys.tolist()):
                for g in guests.get(k, ()):
                    at.append(i)
                    to.append(g)
            packed_ = [pack(t or b"") for t in texts]
            tie = [xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in texts]
            rows_ = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([i < len(batch) for i in range(len(at))]), batch.column("key").take(rows_), batch.column("id").take(rows_), pa.array(tie, pa.int64()).take(rows_), pa.array(packed_, pa.binary()).take(rows_)], ["bucket", "own", "key", "id", "tie", "text"])

    kind = df.schema[id].dataType.simpleString()
    rows = rows.mapInArrow(lean(send), f"bucket int, own boolean, key long, id {kind}, tie long, text binary")
    return by_shard(rows, max(1, n), "bucket").sortWithinPartitions(F.col("bucket"), F.col("own").desc(), F.col("key").desc(), F.col("tie"))


def edited(text: str, next_: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + next_[:k]


def beside_next(df: DataFrame, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row; ``digest``: the edited text's SHA-256 in its place."""
    kind = df.schema[id].dataType.simpleString()

    def made(rows: list[tuple], next_: tuple) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [next_[1]]
        changed = [edited(texts[i], texts[i + 1]) for i in range(len(rows))]
        prints = embedding().fingerprints(texts + changed)
        own, after, new = prints[: len(rows)], prints[1 : len(rows) + 1], prints[len(rows) + 1 :]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa_kind[0]), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()) if digest else pa.array(changed, pa.string()), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in new], pa.binary()), pa.array((own == new).mean(1)), pa.array((own == after).mean(1))],
            ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    pa_kind: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, bucket, guest = [], 0, None, False
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            pa_kind[0] = batch.schema.field("id").type
            for b, own, i, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "own", "id", "text")), strict=True):
                t = unpack(t).decode("utf-8", "replace")
                if b != bucket:
                    held, chars, bucket, guest = [], 0, b, False
                if guest:
                    continue  # further rows of a guest's id
                if held and (chars > CHARS // 2 or not own):
                    yield made(held, (i, t))
                    held, chars = [], 0
                guest = not own
                if own:
                    held.append((i, t))
                    chars += len(t)

    schema = f"id {kind}, n_chars long, edited {'binary' if digest else 'string'}, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return with_next(df, id, text).mapInArrow(lean(run), schema).withColumnRenamed("id", id)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(beside_next(table(spark, sf_dir, "documents"), digest=True))
    low = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_chars", low("edited").alias("edited_sha256"), low("fingerprint").alias("fingerprint"), low("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "group_id")
