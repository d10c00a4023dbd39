"""How far the sources of a language lie apart, and the terms that set each apart from its language.

Each task counts the terms of its documents in sorted runs of (lang, term, source, document) and sends one row for each of its
(lang, term, source). These are dealt by (lang, term), sorted, and scanned run by run: document frequency and counts. The terms that
are kept go, sorted again, through a second scan, which holds one term's counts at a time and emits partial sums for pairs of
sources and the best terms of each source. A language's sources lie in tiles of about ``TILE``, and each two tiles meet in rows of
their own, so no task holds all sources; terms lie in as many buckets as there are partitions, so a hot language or term is spread.

Defined cases: null text, lang and source count as ''. Documents are rows, so repeated rows and ids count again. A text without
terms still makes its (lang, source) occur. Extra columns are neither read nor returned. An empty table gives an empty one.
Integers are exact at any size of counts below a long's range. The result has all pairs of a language's sources, as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import by_shard, byte_table, checkpoint, lean, partitions, slices, table

#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 30
#: Terms of a source that are returned.
TERMS = 50
UNIT, PRIOR = 1_000_000_000, 5
#: Sources of a language whose counts of a term meet in one array.
TILE = 64
#: Rows of counts that a task holds before it sends them.
HELD_ROWS = 400_000
#: A-Z lower-cased; all ASCII but letters separates.
LETTERS = byte_table("".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


# ---------------------------------------------------------------- counts of a task


def slice_counts(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of the texts of a slice; ``group``: of each text."""
    mapped = LETTERS[data]
    inside = mapped != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    opens = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    closes = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    row = np.searchsorted(bounds, opens, "right") - 1
    ends = np.append(0, np.cumsum(closes - opens)).astype(np.int64)
    letters = np.ascontiguousarray(mapped[inside])
    terms = pc.dictionary_encode(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opens), [None, pa.py_buffer(ends), pa.py_buffer(letters)]))
    code = terms.indices.to_numpy().astype(np.int64)
    # Runs of (term, document), then of (term, group).
    run, times = np.unique(code * len(group) + row, return_counts=True)
    groups = int(group.max(initial=0)) + 1
    key, inverse = np.unique(run // len(group) * groups + group[run % len(group)], return_inverse=True)
    documents = np.bincount(inverse, minlength=len(key))
    order = np.argsort(inverse, kind="stable")
    occurrences = np.add.reduceat(times[order], np.cumsum(documents) - documents) if len(key) else times
    return terms.dictionary.take(pa.array(key // groups)), key % groups, documents, occurrences


def counted(df: DataFrame) -> DataFrame:
    """(lang, term, source, documents, n): the counts of each task, by its own rows."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("documents", "sum"), ("n", "sum")]).rename_columns(["lang", "term", "source", "documents", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            pair = pa.Table.from_batches([batch]).select(["lang", "source"])
            kinds = pair.group_by(["lang", "source"]).aggregate([]).select(["lang", "source"])
            kinds = kinds.append_column("group", pa.array(np.arange(len(kinds))))
            pair = pair.append_column("at", pa.array(np.arange(len(pair)))).join(kinds, ["lang", "source"]).sort_by("at")
            group = pair.column("group").to_numpy()
            for a, b, data, bounds in slices(batch.column("text")):
                term, of, documents, n = slice_counts(data, bounds, group[a:b])
                own = kinds.take(pa.array(of))
                held.append(pa.table({"lang": own.column("lang"), "term": term.cast(pa.large_string()), "source": own.column("source"), "documents": pa.array(documents.astype(np.int64)), "n": pa.array(n.astype(np.int64))}))
                rows += len(of)
                if rows > HELD_ROWS:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)

    named = df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return named.mapInArrow(lean(run), "lang string, term string, source string, documents long, n long")


# ---------------------------------------------------------------- run-length scans


def changes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, whole, n) of the terms in ``least`` documents of the language, for each source and (``whole``) the language."""

    def squeezed(t: pa.Table) -> pa.Table:
        """One row for each run of (lang, term, source)."""
        first = np.flatnonzero(changes(*(column(t, c) for c in ("lang", "term", "source"))))
        sums = [pa.array(np.add.reduceat(column(t, c).to_numpy(), first)) for c in ("documents", "n")]
        at = pa.array(first)
        return pa.table([column(t, c).take(at) for c in ("lang", "term", "source")] + sums, names=["lang", "term", "source", "documents", "n"])

    def closed(t: pa.Table) -> pa.Table:
        """The kept rows of whole terms."""
        first = np.flatnonzero(changes(column(t, "lang"), column(t, "term")))
        documents, n = (np.add.reduceat(column(t, c).to_numpy(), first) for c in ("documents", "n"))
        size = np.diff(np.append(first, len(t)))
        good = documents >= least
        own, total = t.filter(pa.array(np.repeat(good, size))), t.take(pa.array(first[good]))
        out = lambda x, whole, n: pa.table([column(x, "lang"), column(x, "term"), pa.array([""] * len(x), column(x, "source").type) if whole else column(x, "source"), pa.array(np.full(len(x), whole)), pa.array(n)], names=["lang", "term", "source", "whole", "n"])
        both = pa.concat_tables([out(own, False, column(own, "n").to_numpy()), out(total, True, n[good])])
        return both.combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = squeezed(t if open_ is None else pa.concat_tables([open_, t]))
            last = int(np.flatnonzero(changes(column(t, "lang"), column(t, "term")))[-1])
            if last:
                yield from closed(t[:last]).to_batches()
            open_ = t[last:]
        if open_ is not None:
            yield from closed(open_).to_batches()

    dealt = counts.repartition(partitions(counts.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(lean(run), "lang string, term string, source string, whole boolean, n long")


def rates(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / (total + 5 v)), exact."""
    if int(n.max(initial=0)) + PRIOR < (1 << 63) // UNIT:
        return 1 + UNIT * (n + PRIOR) // (total + PRIOR * v)
    return (1 + UNIT * (n.astype(object) + PRIOR) // (total + PRIOR * v)).astype(np.int64)


class Tiles:
    """The sources of two tiles of a language (or of one, twice), and what their terms add up to."""

    def __init__(self, head: pa.Table):
        first = head.slice(0, 1).to_pylist()[0]
        self.lang, self.one = first["lang"], first["lo"] == first["hi"]
        self.v, self.total = first["v"], first["lang_total"]
        self.sources = column(head, "source")
        self.totals = column(head, "n").to_numpy()
        tile = column(head, "tile").to_numpy()
        self.left = np.flatnonzero(tile == first["lo"])
        self.right = self.left if self.one else np.flatnonzero(tile == first["hi"])
        self.base = rates(np.zeros(len(self.totals), np.int64), self.totals, self.v) if self.v else np.zeros(len(self.totals), np.int64)
        self.apart = np.zeros((len(self.left), len(self.right)), np.int64)
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def sums(self, p: np.ndarray) -> np.ndarray:
        """For each left and right source: the sum of the differences over the rows of ``p``."""
        r = p[:, self.right]
        return np.array([np.abs(r - p[:, a : a + 1]).sum(0) for a in self.left], np.int64).reshape(self.apart.shape)

    def absent(self) -> np.ndarray:
        return self.sums(self.base[None])

    def add(self, t: pa.Table) -> None:
        """The rows of whole terms, sorted: of the sources, and (in one tile) of the language."""
        term = column(t, "term")
        new = changes(term)
        first, at = np.flatnonzero(new), np.cumsum(new) - 1
        whole, n = column(t, "whole").to_numpy(zero_copy_only=False), column(t, "n").to_numpy()
        slot = pc.index_in(column(t, "source"), self.sources).to_numpy(zero_copy_only=False)
        counts = np.zeros((len(first), len(self.totals)), np.int64)
        own = np.flatnonzero(~whole)
        counts[at[own], slot[own].astype(np.int64)] = n[own]
        p = rates(counts, self.totals, self.v)
        self.apart += self.sums(p) - len(first) * self.absent()
        if self.one:
            q = np.zeros(len(first), np.int64)
            q[at[whole]] = n[whole]
            f = p - rates(q, np.int64(self.total), self.v)[:, None]
            f[counts == 0] = 0
            for s in range(len(self.totals)):
                rows = np.flatnonzero(f[:, s] > 0)
                rows = rows[np.argsort(-f[rows, s], kind="stable")[:TERMS]]
                if len(rows):
                    more = zip(f[rows, s].tolist(), term.take(pa.array(first[rows])).to_pylist(), strict=True)
                    self.best[s] = sorted(self.best.get(s, []) + [(-x, y.encode()) for x, y in more])[:TERMS]

    def out(self) -> pa.RecordBatch:
        """Partial sums of pairs, each once, and the best terms so far."""
        i, j = np.nonzero(np.triu(np.ones(self.apart.shape, bool), 1) if self.one else np.ones(self.apart.shape, bool))
        names = self.sources.to_pylist()
        rows = [(names[self.left[a]], "pair", names[self.right[b]], int(self.apart[a, b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        rows += [(names[s], "term", y.decode(), -x) for s, best in self.best.items() for x, y in best]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["lang", "source", "part", "item", "value"])


def scanned(rows: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): partial sums for pairs and the best terms, from rows sorted by tiles, bucket and term, the sources first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: Tiles | None = None
        key = of = None  # (lang, lo, hi, bucket) of the run, and (lang, lo, hi) of the tiles
        head: list[pa.Table] = []
        open_: pa.Table | None = None

        def settle() -> None:
            """The run's sources are all known."""
            nonlocal tiles, head, of
            if head:
                t = pa.concat_tables(head).combine_chunks()
                head = []
                if of != key[:3]:
                    tiles, of = Tiles(t), key[:3]
                if key[3] == 0:
                    tiles.apart += tiles.v * tiles.absent()

        def close() -> None:
            nonlocal open_
            settle()
            if open_ is not None and tiles is not None:
                tiles.add(open_.combine_chunks())
            open_ = None

        for batch in batches:
            t = pa.Table.from_batches([batch])
            cuts = np.flatnonzero(changes(*(t.column(c) for c in ("lang", "lo", "hi", "bucket"))))
            for a, b in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
                part = t[int(a) : int(b)].combine_chunks()
                own = tuple(part.column(c)[0].as_py() for c in ("lang", "lo", "hi", "bucket"))
                if own != key:
                    if key is not None:
                        close()
                    if tiles is not None and own[:3] != of:
                        yield tiles.out()
                        tiles = of = None
                    key = own
                sources = int(pc.sum(pc.equal(part.column("kind"), 0)).as_py() or 0)
                if sources:
                    head.append(part[:sources])
                part = part[sources:]
                if not len(part):
                    continue
                settle()
                if tiles is None:  # no source hashes to this tile
                    continue
                part = part if open_ is None else pa.concat_tables([open_, part])
                last = int(np.flatnonzero(changes(column(part, "term")))[-1])
                if last:
                    tiles.add(part[:last].combine_chunks())
                open_ = part[last:]
        if key is not None:
            close()
        if tiles is not None:
            yield tiles.out()

    return rows.mapInArrow(lean(run), "lang string, source string, part string, item string, value long")


def audit(df: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair``, every other source of the language by distance; ``term``, the terms that set the source apart."""
    assert terms <= TERMS
    buckets = partitions(df.sparkSession)
    kept = checkpoint(kept_terms(counted(df.select("lang", "source", "text")), least))
    sums = kept.groupBy("lang", "source", "whole").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    langs = sums.where("whole").select("lang", F.col("n").alias("lang_total"), "v")
    occurring = df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = occurring.join(sums.where("not whole").select("lang", "source", "n"), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = checkpoint(groups.select("lang", "source", zero("n"), zero("lang_total"), zero("v")))
    tiles = checkpoint(groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))

    of = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = [F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")]
    head = groups.join(tiles, "lang").withColumn("tile", of).withColumn("other", other).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    head = head.select("lang", *met, "bucket", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", F.lit(False).alias("whole"), "n", "tile", "lang_total", "v")
    body = kept.join(tiles, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("tile", F.when(~F.col("whole"), of)).withColumn("other", other)
    met = [F.when(F.col("whole"), F.col("other")).otherwise(c).alias(n) for c, n in ((F.least("tile", "other"), "lo"), (F.greatest("tile", "other"), "hi"))]
    body = body.select("lang", *met, "bucket", F.lit(1).alias("kind"), "term", "source", "whole", "n", "tile", F.lit(0).cast("long").alias("lang_total"), F.lit(0).cast("long").alias("v"))
    # A task has one bucket of each two tiles, so that all tasks emit as many partial sums.
    rows = by_shard(head.unionAll(body), buckets, "bucket").sortWithinPartitions("lang", "lo", "hi", "bucket", "kind", "term", "whole", "source")
    found = checkpoint(scanned(rows))

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionAll(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    both = pairs.unionAll(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= terms))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
