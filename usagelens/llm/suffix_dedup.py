"""Suffix-array deduplication: every byte in a ``length``-byte string that starts earlier too is removed.

1. Anchors. Each window of ``length`` bytes picks the ``ANCHOR``-byte string in it with the least hash (the
   first of several). Equal windows pick the same one, at the same place in them, so what decides about a
   window is found where its anchor's hash is. Windows next to each other mostly share an anchor; such a run
   is one entry. Anchors that occur once have no equal windows.
2. The runs with repeated anchors are cut out of the texts and sent, with ``length - 1`` bytes after their last
   start, to the shard of their anchor. A text that a task cut out before goes as a reference.
3. A shard spools its distinct cut-outs to a scratch file and sorts their suffixes by external induced sorting (``induced.py``), in parts of
   about ``PART_BYTES``, several times what the queue holds in memory; one anchor is one part at least, however large. Neighbours that share ``length`` bytes or more are one class. All
   occurrences of a class but the earliest are removed.
4. Removed ranges go back to their documents and are merged there.

No step needs the rows of one key together but the sorting of different cut-outs around one anchor. Entries
travel as packed arrays, one row for each batch and shard. The texts are shuffled once, for both joins.

Defined cases: null and empty texts have no bytes; texts under ``length`` bytes keep all. The order of documents
is that of their ids. If ids are null or repeat, the order is that of (id, nulls first; text), one after the
other. Extra columns are kept by ``without_repeats`` and not read by ``repeats``. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import by_shard, fresh, lean, mix, numbered, partitions, powers, slices, table
from usagelens.llm.induced import suffix_array

U = np.uint64
LENGTH = 100
ANCHOR = 32
PART_BYTES = 4 << 20


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, number of starts, anchor hash) of the maximal runs of windows with one anchor. Starts count within the text."""
    n = len(data)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= length)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U)
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up, out=total[1:])
    grams = n - anchor + 1
    h = mix((total[anchor:] - total[:grams]) * down[:grams])
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U)
    window, width = length - anchor + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    counts = size[rows] - length + 1
    starts = np.repeat(offsets[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    at = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    row = np.repeat(rows, counts)[first]
    # The picked hashes are small ones; mixed anew they spread over the shards.
    return row, starts[first] - offsets[row], np.diff(np.append(first, len(at))), mix(h[at[first]] + U(1))


def packed(shard: np.ndarray, shards: int, columns: list[np.ndarray], names: list[str], extra: dict[str, list[bytes]] | None = None) -> pa.RecordBatch | None:
    """A row for each shard that has entries: its part of each column as bytes."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    arrays = [pa.array(full.astype(np.int32))]
    for c in columns:
        c = c[order]
        arrays.append(pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()))
    for v in (extra or {}).values():
        arrays.append(pa.array([v[i] for i in full], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["shard", *names, *(extra or {})])


def by_id(ids: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each id: its entries of each column as bytes."""
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], [c[order] for c in columns]
    cut = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)) if len(ids) else np.zeros(1, np.int64)
    parts = [[c[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(ids[cut[:-1]]), *[pa.array(p, pa.binary()) for p in parts]], ["id", *names])


def all_of(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> list[np.ndarray]:
    got = {c: [] for c in kinds}
    for batch in batches:
        for c in kinds:
            got[c] += batch.column(c).to_pylist()
    return [np.frombuffer(b"".join(got[c]), k) for c, k in kinds.items()]


def earlier(texts: list[bytes], starts: list[int], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct cut-outs with ``starts[i]`` windows, whose first occurrence is at (doc, at): (cut-out, window) pairs that occur earlier elsewhere."""
    string = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.uint16) + np.uint16(1)
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    string[begin + sizes] = 0
    order, lcp = suffix_array(string)
    del string
    # Of the suffixes only those that share enough with a neighbour are taken from the array.
    with_before = np.append(lcp >= length, False)
    on = np.flatnonzero(with_before[:-1] | with_before[1:])
    group = np.cumsum(~with_before[on], dtype=order.dtype)
    order = np.asarray(order[on])
    del lcp, with_before, on
    which = (np.searchsorted(begin, order, "right") - 1).astype(order.dtype)
    window = order - begin.astype(order.dtype)[which]
    del order
    own = window < np.array(starts)[which]
    group, which, window = group[own], which[own], window[own]
    lone = np.bincount(group)[group] > 1
    group, which, window = group[lone], which[lone], window[lone]
    by = np.lexsort((at[which] + window, doc[which], group))
    group, which, window = group[by], which[by], window[by]
    later = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    return which[later], window[later]


def ranges(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(id, starts, counts): runs of removed windows of (id, text) with distinct, non-null long ids, as packed arrays."""
    spark = docs.sparkSession
    shards = partitions(spark)

    def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
        for a, _, data, offsets in slices(column):
            yield a, data, offsets, runs_of(data, offsets, length, anchor)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made = batch.column(0).to_numpy(zero_copy_only=False), []
            for a, _, _, (row, _, _, h) in runs(batch.column(1)):
                number = np.arange(len(row)) - np.searchsorted(row, row)
                made.append((h, ids[a + row], number.astype(np.uint32)))
            if made:
                h, doc, number = (np.concatenate(x) for x in zip(*made, strict=True))
                shard = ((h >> U(32)) * U(shards)) >> U(32)
                yield packed(shard.astype(np.int64), shards, [(h & U(0xFFFFFFFF)).astype(np.uint32), doc.astype(np.int64), number], ["h", "doc", "number"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, number = all_of(batches, {"h": np.uint32, "doc": np.int64, "number": np.uint32})
        if len(h):
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            on = order[np.append(same, False) | np.append(False, same)]
            if len(on):
                yield by_id(doc[on], [number[on]], ["numbers"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("numbers").to_pylist()
            hs, docs_, ats, counts, keys = [], [], [], [], []
            texts: list[list[tuple[int, bytes, int]]] = [[] for _ in range(shards)]
            for a, data, offsets, (row, start, count, h) in runs(batch.column("text")):
                raw, lo = data.tobytes(), np.searchsorted(row, np.arange(len(offsets)))
                on = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + lo[i] for i in range(len(offsets) - 1) for x in marks[a + i]] or [np.zeros(0, np.int64)])
                on.sort()
                row, start, count, h = row[on], start[on], count[on], h[on]
                shard = (((h >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
                begin = offsets[row] + start
                key = np.zeros(len(row), U)
                for i, (b, e, s) in enumerate(zip(begin.tolist(), (begin + count - 1 + length).tolist(), shard.tolist(), strict=True)):
                    piece = raw[b:e]
                    key[i] = k = xxhash.xxh3_64_intdigest(piece)
                    if k not in sent:
                        sent.add(k)
                        texts[s].append((k, piece, int(count[i])))
                if len(sent) > 2_000_000:
                    sent.clear()
                for into, x in zip((hs, docs_, ats, counts, keys), (h, ids[a + row], start, count, key), strict=True):
                    into.append(x)
            if not hs or not sum(map(len, hs)):
                continue
            h, doc, at, count, key = map(np.concatenate, (hs, docs_, ats, counts, keys))
            shard = (((h >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
            extra = {
                "text_keys": [np.array([k for k, _, _ in t], U).tobytes() for t in texts],
                "text_sizes": [np.array([len(x) for _, x, _ in t], np.uint32).tobytes() for t in texts],
                "texts": [b"".join([x for _, x, _ in t]) for t in texts],
            }
            yield packed(shard, shards, [(h & U(0xFFFFFFFF)).astype(np.uint32), doc.astype(np.int64), at.astype(np.int64), count.astype(np.uint32), key], ["h", "doc", "at", "count", "key"], extra)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int]] = {}  # place and size of each distinct cut-out in the spool
        spool, spooled = tempfile.TemporaryFile(prefix="cut-outs-"), 0
        columns = {"h": np.uint32, "doc": np.int64, "at": np.int64, "count": np.uint32, "key": U}
        got = {c: [] for c in columns}
        for batch in batches:
            for c in columns:
                got[c] += batch.column(c).to_pylist()
            for keys, sizes, text in zip(*(batch.column(c).to_pylist() for c in ("text_keys", "text_sizes", "texts")), strict=True):
                end = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
                begin = 0
                for k, e in zip(np.frombuffer(keys, U).tolist(), end, strict=True):
                    if k not in held:
                        held[k] = (spooled, e - begin)
                        spool.write(memoryview(text)[begin:e])
                        spooled += e - begin
                    begin = e
        spool.flush()
        h, doc, at, count, key = (np.frombuffer(b"".join(got[c]), k) for c, k in columns.items())
        del got
        if not len(h):
            return
        # Cut-outs in the order of their anchors, occurrences of each in that of the documents.
        order = np.lexsort((at, doc, key, h))
        h, doc, at, count, key = h[order], doc[order], at[order], count[order].astype(np.int64), key[order]
        first = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))
        yield from_starts(doc[~first], at[~first], count[~first])
        heads = np.flatnonzero(first)
        sizes = np.cumsum(count[heads] + length)
        anchor_edge = np.append(np.flatnonzero(np.append(True, h[heads][1:] != h[heads][:-1])), len(heads))
        a = 0
        while a < len(heads):
            done = sizes[a - 1] if a else 0
            b = int(np.searchsorted(sizes, done + PART_BYTES, "right"))
            later = anchor_edge[anchor_edge > a]
            fit = later[later <= b]
            b = int(fit[-1] if len(fit) else later[0])
            some = heads[a:b]
            which, window = earlier([os.pread(spool.fileno(), size, place) for place, size in (held[k] for k in key[some].tolist())], count[some].tolist(), doc[some], at[some], length)
            if len(which):
                by = np.lexsort((window, which))
                which, window = which[by], window[by]
                new = np.append(True, (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1))
                begin = np.flatnonzero(new)
                yield from_starts(doc[some][which[begin]], at[some][which[begin]] + window[begin], np.diff(np.append(begin, len(which))))
            a = b
        spool.close()

    def from_starts(doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return by_id(doc, [at.astype(np.int64), count.astype(np.int64)], ["starts", "counts"])

    found = by_shard(docs.mapInArrow(lean(anchors), "shard int, h binary, doc binary, number binary"), shards).mapInArrow(lean(repeated), "id long, numbers binary")
    marked = docs.join(found.groupBy("id").agg(F.collect_list("numbers").alias("numbers")), "id").select("id", "text", "numbers")
    pieces = marked.mapInArrow(lean(cut), "shard int, h binary, doc binary, at binary, count binary, key binary, text_keys binary, text_sizes binary, texts binary")
    removed = by_shard(pieces, shards).mapInArrow(lean(sort), "id long, starts binary, counts binary")
    return removed.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("counts").alias("counts"))


def spans_of(starts: list[bytes] | None, counts: list[bytes] | None, length: int) -> np.ndarray:
    """The merged byte ranges of runs of removed windows."""
    if not starts:
        return np.zeros((0, 2), np.int64)
    a = np.concatenate([np.frombuffer(x, np.int64) for x in starts])
    b = a + np.concatenate([np.frombuffer(x, np.int64) for x in counts]) - 1 + length
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return np.column_stack([a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]])


def joined(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(id, text, starts, counts) of (id, text); the texts are exchanged once for this join and that inside."""
    docs = docs.where("id is not null")
    return docs.join(ranges(docs, length, anchor), "id", "left").select("id", "text", "starts", "counts")


def kept_of(raw: bytes, spans: np.ndarray) -> bytes:
    out, last = [], 0
    for a, b in spans.tolist():
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]])


def repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): the removed byte ranges of each row and the bytes that stay."""
    rows, key, plain = numbered(df.select(F.col(id).alias("name"), F.col(text).alias("text")), "name", "text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(s, c, length) for s, c in zip(batch.column("starts").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            for a, b, data, offsets in slices(batch.column("text")):
                raw = data.tobytes()
                mine = [raw[offsets[i] : offsets[i + 1]] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], pa.array(np.diff(offsets)), pa.array([[{"start": x, "end": y} for x, y in s.tolist()] for s in spans[a:b]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([kept_of(r, s) for r, s in zip(mine, spans[a:b], strict=True)], pa.binary())],
                    ["id", "n_bytes", "spans", "kept"],
                )

    out = joined(rows.select(F.col(key).alias("id"), "text"), length, anchor).mapInArrow(lean(finish), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    if plain:
        return out.withColumnRenamed("id", id)
    return out.join(rows.select(key, "name"), F.col("id") == F.col(key)).select(F.col("name").alias(id), "n_bytes", "spans", "kept")


def without_repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The rows with what repeats cut out of the text, to whole characters; ``size``, if there, is the text's new number of characters."""
    rows, key, _ = numbered(df, id, text)
    names = df.columns
    at, begin, many = (fresh(rows, x) for x in ("_at", "_starts", "_counts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            starts, counts = batch.column(begin).to_pylist(), batch.column(many).to_pylist()
            for i, (s, c) in enumerate(zip(starts, counts, strict=True)):
                if s:
                    texts[i] = kept_of(texts[i].encode(), spans_of(s, c, length)).decode("utf-8", "ignore")
            columns = {n: batch.column(n) for n in names} | {text: pa.array(texts, batch.schema.field(text).type)}
            if size in names:
                changed = [len(t) if s else n for t, s, n in zip(texts, starts, batch.column(size).to_pylist(), strict=True)]
                columns[size] = pa.array(changed, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    found = ranges(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), length, anchor)
    found = found.select(F.col("id").alias(at), F.col("starts").alias(begin), F.col("counts").alias(many))
    return rows.join(found, F.col(key) == F.col(at), "left").select(*names, begin, many).mapInArrow(lean(finish), df.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
