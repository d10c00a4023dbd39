"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all token windows.

Words are the lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is ``window``
consecutive words of one item, or a shorter item as a whole. The driver builds an index of the items (a
vocabulary, and for each window length the sorted hashes of the windows' word numbers) and broadcasts it, if
the items' texts are within ``limit_bytes``; the scan numbers each document's words, hashes those windows
whose words are all in the vocabulary, looks the hashes up and verifies each hit word by word, so it is exact.
Larger benchmarks take another way with the same result: 64-bit hashes of all windows of both sides meet in a shuffled join, and each
text compares its words with those of the windows it met. Texts stand for themselves there, so rows are judged by their text alone.

Defined cases: null and empty texts have no words and no hits; items without words have no window. Repeated
document rows are each judged; repeated items count once by item_id. A null item_id is ignored. The report
reads only id and text; the filters keep all columns of their input as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import ALNUM_WORDS, fresh, lean, mix, slices, table, word_hashes

WINDOW = 10
#: Largest benchmark (bytes of text) that is collected and broadcast.
LIMIT_BYTES = 16 << 20
REPORT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
U = np.uint64
_TO_BLANK = bytes(int(x) or 32 for x in ALNUM_WORDS)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hashes_of(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    h = np.full(len(at), m, U)
    for j in range(m):
        h = mix(h ^ ids[at + j].astype(U)) + U(j)
    return h


class Index:
    """The windows of a benchmark of bounded size."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.encode().translate(_TO_BLANK).split()]
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                held[m][tuple(words[i : i + m])].add(item)
        self.by_length = {}
        for m, windows in held.items():
            ids = np.array(list(windows), np.int64)
            h = hashes_of(ids.ravel(), np.arange(len(ids)) * m, m)
            order = np.argsort(h, kind="stable")
            names = list(windows.values())
            self.by_length[m] = (h[order], ids[order], [names[i] for i in order])

    def hits(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words of hit windows, number of the window) over word numbers and their rows."""
        known = np.append(0, np.cumsum(words > 0))
        for m, (h, ids, _) in self.by_length.items():
            if len(words) < m:
                continue
            at = np.flatnonzero((known[m:] - known[:-m] == m) & (rows[m - 1 :] == rows[: len(rows) - m + 1]))
            if not len(at):
                continue
            mine = hashes_of(words, at, m)
            lo, hi = np.searchsorted(h, mine), np.searchsorted(h, mine, "right")
            while len(at):  # more than one turn only for windows of equal hash
                on = lo < hi
                at, lo, hi = at[on], lo[on], hi[on]
                same = (words[at[:, None] + np.arange(m)] == ids[lo]).all(axis=1) if len(at) else np.zeros(0, bool)
                if same.any():
                    yield m, at[same], lo[same]
                lo = lo + 1

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, list[str], np.ndarray | None]]]]:
        """(first row, end row, [(n_words, n_hit, items, mask of hit words if any)])."""
        get = self.vocabulary.get
        for a, b, data, offsets in slices(column):
            blank = data.tobytes().translate(_TO_BLANK)
            numbers, counts = [], []
            for i in range(b - a):
                words = blank[offsets[i] : offsets[i + 1]].split()
                counts.append(len(words))
                numbers.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            words = np.concatenate(numbers)
            rows = np.repeat(np.arange(b - a), counts)
            hit, items = np.zeros(len(words) + 1, np.int64), defaultdict(set)
            for m, at, which in self.hits(words, rows):
                np.add.at(hit, at, 1)
                np.add.at(hit, at + m, -1)
                names = self.by_length[m][2]
                for r, w in zip(rows[at], which, strict=True):
                    items[int(r)] |= names[w]
            on = np.cumsum(hit)[:-1] > 0
            first = np.append(0, np.cumsum(counts))
            yield a, b, [(counts[i], int(on[first[i] : first[i + 1]].sum()), sorted(items[i]), on[first[i] : first[i + 1]]) if i in items else (counts[i], 0, [], None) for i in range(b - a)]


def spans_of(raw: bytes, on: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of hit words."""
    places = [m.span() for m in _WORD.finditer(raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(places[i][0], places[j - 1][1]) for i, j in edges.reshape(-1, 2)]


def index_of(benchmark: DataFrame, window: int, limit_bytes: int, item: str = "item_id", text: str = "text") -> Index | None:
    """The index, or None if the benchmark is too large to broadcast."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) > limit_bytes:
        return None
    return Index([tuple(r) for r in items.collect()], window)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit_bytes: int = LIMIT_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each row; spans are byte ranges of hit words."""
    kind = docs.schema[id].dataType.simpleString()
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    index = index_of(benchmark, window, limit_bytes)
    if index is None:
        return shuffled_report(docs, benchmark, window, kind).withColumnRenamed("id", id)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in sent.value.scan(batch.column(1)):
                spans = [[] if on is None else [{"start": s, "end": e} for s, e in spans_of(batch.column(1)[a + i].as_py().encode(), on)] for i, (_, _, _, on) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(lean(run), f"id {kind}, {REPORT}").withColumnRenamed("id", id)


def text_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_BLANK).split()


def judged(text: str | None, hits: list[dict] | None) -> tuple[int, np.ndarray, list[str]]:
    """(number of words, mask of hit words, items) of a text and the windows that it met by hash."""
    words = words_of((text or "").encode())
    on, items = np.zeros(len(words), bool), set()
    for x in hits or ():
        if words[x["at"] : x["at"] + x["m"]] == x["gram"].encode().split(b" "):
            on[x["at"] : x["at"] + x["m"]] = True
            items.update(x["items"])
    return len(words), on, sorted(items)


def shuffled_hits(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> DataFrame:
    """(key, hits) of each text that meets a window by hash, for a benchmark of any size; a hit has the place in words, the length, the words and their items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("text")).where("key is not null and text is not null")

    def windows(lengths: list[int], of_items: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in slices(batch.column(1)):
                    rows, h, _, _ = word_hashes(data, offsets, ALNUM_WORDS)
                    bounds = np.searchsorted(rows, np.arange(b - a + 1))
                    words = words_of(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in range(b - a))) if of_items else []
                    for m in lengths:
                        if len(h) < m:
                            continue
                        at = np.flatnonzero(rows[m - 1 :] == rows[: len(rows) - m + 1])
                        if of_items and m < window:
                            at = at[(bounds[1:] - bounds[:-1])[rows[at]] == m]
                        g = np.full(len(at), m, U)
                        for j in range(m):
                            g = mix(g ^ h[at + j]) + U(j)
                        last = pa.array([b" ".join(words[i : i + m]) for i in at], pa.binary()).cast(pa.string()) if of_items else pa.array((at - bounds[rows[at]]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + rows[at])), pa.array(g.view(np.int64)), pa.array(np.full(len(at), m, np.int32)), last], ["key", "h", "m", "gram" if of_items else "at"])

        return run

    wanted = items.mapInArrow(lean(windows(list(range(1, window + 1)), True)), "key string, h long, m int, gram string")
    wanted = wanted.groupBy("h", "m", "gram").agg(F.collect_set("key").alias("items"))
    lengths = sorted(r[0] for r in wanted.select("m").distinct().collect())
    texts = docs.select(text_key(text).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0).dropDuplicates(["key"])
    met = texts.mapInArrow(lean(windows(lengths, False)), "key string, h long, m int, at int").join(wanted, ["h", "m"])
    return met.groupBy("key").agg(F.collect_list(F.struct("at", "m", "gram", "items")).alias("hits"))


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> tuple[DataFrame, str]:
    """The rows with the hits of their text, and the name of that column."""
    key, hits, own = fresh(docs, "_key"), fresh(docs, "_hits"), fresh(docs, "_text")
    met = shuffled_hits(docs, benchmark, window, text).select(F.col("key").alias(own), F.col("hits").alias(hits))
    rows = docs.withColumn(key, text_key(text))
    return rows.join(met, rows[key] == met[own], "left").select(*docs.columns, hits), hits


def shuffled_report(docs: DataFrame, benchmark: DataFrame, window: int, kind: str) -> DataFrame:
    """The report for a benchmark of any size."""
    rows, hits = with_hits(docs, benchmark, window, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [judged(t, h) for t, h in zip(texts, batch.column(2).to_pylist(), strict=True)]
            spans = [[{"start": s, "end": e} for s, e in spans_of(t.encode(), on)] if on.any() else [] for t, (_, on, _) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([int(x[1].sum()) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "n_hit", "items", "spans"])

    return rows.select("id", "text", hits).mapInArrow(lean(run), f"id {kind}, {REPORT}")


def cut_out(text: str, on: np.ndarray) -> str:
    """The text without its hit words."""
    raw, kept, last = text.encode(), [], 0
    for s, e in spans_of(raw, on):
        kept.append(raw[last:s])
        last = e
    return b"".join([*kept, raw[last:]]).decode()


def masks(benchmark: Index | None, batch: pa.RecordBatch, at: int) -> Iterator[np.ndarray | None]:
    """For each row the mask of its hit words, None without any; without an index from the last column's hits."""
    if benchmark is not None:
        for _, _, found in benchmark.scan(batch.column(at)):
            yield from (on if n else None for _, n, _, on in found)
        return
    for t, h in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
        on = judged(t, h)[1] if h else None
        yield on if on is not None and on.any() else None


def filtered(docs: DataFrame, benchmark: DataFrame, window: int, limit_bytes: int, text: str, cut: bool) -> DataFrame:
    """The rows without a hit, or all rows with their hits cut out; the same by either way."""
    index, at, schema = index_of(benchmark, window, limit_bytes), docs.columns.index(text), docs.schema
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs if index is not None else with_hits(docs, benchmark, window, text)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = list(masks(sent.value, batch, at))
            out = batch.select(range(len(schema.fields)))
            if not cut:
                yield out.filter(pa.array([on is None for on in hit], pa.bool_()))
                continue
            texts = batch.column(at).to_pylist()
            texts = [t if on is None else cut_out(t, on) for t, on in zip(texts, hit, strict=True)]
            yield out.set_column(at, text, pa.array(texts, batch.schema.field(at).type))

    return rows.mapInArrow(lean(run), schema)


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit_bytes: int = LIMIT_BYTES, text: str = "text") -> DataFrame:
    """The rows without a hit, as they are."""
    return filtered(docs, benchmark, window, limit_bytes, text, False)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit_bytes: int = LIMIT_BYTES, text: str = "text") -> DataFrame:
    """All rows, their hit words cut out of the text."""
    return filtered(docs, benchmark, window, limit_bytes, text, True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
