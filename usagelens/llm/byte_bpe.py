"""Byte-level BPE encoding and decoding with a vectorised split into pre-tokens.

Each code point has a class. An automaton over classes knows, at each code point, what the pattern's match in progress holds, and
says where a match begins (``here`` at this code point, ``back`` at the one before). The functions from state to state that
class sequences stand for are finitely many and compose associatively, so a scan over their numbers (lanes side by side, then a
tree over the lanes) gives all states at once, without a regular expression. The slices found are told apart exactly and merged
once each, with a cache; where each token starts in the text is kept, and decoding puts the tokens' bytes back there.

Defined cases: null and empty texts have no tokens and decode to nothing. Repeated rows give repeated rows. Extra columns are
neither read nor returned. An empty table gives an empty one. Texts are worked on in windows of about 1 MB, cut at a match's start,
from which the pattern starts afresh; one match longer than that is a window of its own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import SLICE_BYTES, lean, slices, table

#: Entries of a worker's cache of slices; it is emptied when full.
CACHE_ENTRIES = 200_000
#: Slices of more bytes are merged by a queue and aren't cached.
LONG_SLICE = 256
#: Lanes of a scan.
LANES = 4096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- classes and the automaton

#: Classes: a space, other white space, number, other, apostrophe; letters that may follow an apostrophe: one of stmd, one of rv, l, e; other letters; the end of a text.
SPACE, WHITE, NUMBER, OTHER, APOSTROPHE, STMD, RV, L, E, LETTER, END = range(11)
#: States: what the match in progress holds. After an apostrophe that opens a match: it alone, with r or v, with l.
START, ONE_SPACE, ONE_WHITE, ENDS_SPACE, ENDS_WHITE, NUMBERS, OTHERS, LETTERS, QUOTE, QUOTE_RV, QUOTE_L = range(11)


def step(state: int, c: int) -> tuple[int, bool, bool]:
    """(next state, whether a match begins here, whether one began at the code point before)."""
    ending = {(QUOTE, STMD): START, (QUOTE, RV): QUOTE_RV, (QUOTE, L): QUOTE_L, (QUOTE_RV, E): START, (QUOTE_L, L): START}
    if (state, c) in ending:
        return ending[state, c], False, False
    back = state in (QUOTE_RV, QUOTE_L)  # no ending after all: the apostrophe stands alone, the letter opens a word
    state = {QUOTE: OTHERS, QUOTE_RV: LETTERS, QUOTE_L: LETTERS}.get(state, state)
    white = state in (ONE_SPACE, ONE_WHITE, ENDS_SPACE, ENDS_WHITE)
    if c == END:
        return START, True, back
    if c in (SPACE, WHITE):
        if white:
            return (ENDS_SPACE if c == SPACE else ENDS_WHITE), False, False
        return (ONE_SPACE if c == SPACE else ONE_WHITE), True, back
    back |= state in (ENDS_SPACE, ENDS_WHITE)  # the last of several white spaces isn't with the others
    run = NUMBERS if c == NUMBER else OTHERS if c in (OTHER, APOSTROPHE) else LETTERS
    if state == run or state in (ONE_SPACE, ENDS_SPACE):  # a space opens the run that follows
        return run, False, back
    return (QUOTE if c == APOSTROPHE else run), True, back


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(functions as rows, their composition table ``first, then second``, the number of each class's function); 0 is the identity."""
    letters = [tuple(step(s, c)[0] for s in range(11)) for c in range(11)]
    found = {tuple(range(11)): 0}
    todo = list(found)
    for f in todo:
        for g in letters:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    rows = np.array(todo, np.uint8)
    then = np.array([[found[tuple(g[list(f)].tolist())] for g in rows] for f in todo], np.uint16)
    return rows, then, np.array([found[f] for f in letters], np.uint16)


FUNCTIONS, THEN, OF_CLASS = monoid()
BEGINS = np.array([[step(s, c)[1] for c in range(11)] for s in range(11)]).ravel()
BEGAN = np.array([[step(s, c)[2] for c in range(11)] for s in range(11)]).ravel()


def states(classes: np.ndarray) -> np.ndarray:
    """The state before each code point, from START on."""
    n = len(classes)
    lanes = min(LANES, max(1, n // 64))
    height = max(1, -(-n // lanes))
    f = np.zeros(lanes * height, np.uint16)
    f[:n] = OF_CLASS[classes]
    f = np.ascontiguousarray(f.reshape(lanes, height).T)
    count, flat = len(FUNCTIONS), THEN.ravel()
    for i in range(1, height):
        f[i] = flat[f[i - 1].astype(np.int64) * count + f[i]]
    whole, by = f[-1].astype(np.int64), 1
    while by < lanes:  # a lane's function with those of all lanes before
        whole = np.concatenate([whole[:by], flat[whole[:-by] * count + whole[by:]].astype(np.int64)])
        by *= 2
    first = np.append(START, FUNCTIONS[whole[:-1], START]).astype(np.int64)
    out = np.empty((height, lanes), np.uint8)
    out[0] = first
    out[1:] = FUNCTIONS.ravel()[f[:-1].astype(np.int64) * 11 + first]
    return out.T.ravel()[:n]


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point. Letters, numbers and white space are what the tokenizer's library takes for such, whose Unicode is newer than Python's."""
    global _classes
    if _classes is None:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, OTHER, np.uint8)
        for c, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            engine = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            out[np.frombuffer(bytes(engine.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = c
        for c, which in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (RV, "rv"), (L, "l"), (E, "e")):
            out[list(which.encode())] = c
        _classes = out
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each starts) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.uint32)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        own = np.flatnonzero((lead >= low) & (lead < high))
        x = points[own] & (0xFF >> size + 1)
        for i in range(1, size):
            x = (x << 6) | (data[at[own] + i] & 0x3F)
        points[own] = x
    return points, at


def starts(data: np.ndarray, offsets: np.ndarray, ended: bool = True) -> np.ndarray:
    """The first byte of each pre-token of the texts; without ``ended`` those alone that any further text leaves as they are."""
    points, at = code_points(data)
    kinds = classes()[points]
    if ended:
        ends = np.searchsorted(at, offsets[1:])
        kinds = np.insert(kinds, ends, END)
    key = states(kinds).astype(np.int64) * 11 + kinds
    begins = BEGINS[key]
    begins[:-1] |= BEGAN[key[1:]]
    return at[np.delete(begins, ends + np.arange(len(ends))) if ended else begins]


# ---------------------------------------------------------------- merging


class ByteBPE:
    """A rank file: merging of slices with a cache, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, i in self.ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.append(0, np.cumsum(self.size))[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a slice: the pair of least rank is merged, the leftmost first, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG_SLICE:
            return self._merge_long(piece)
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        none = len(ranks) + len(self.size)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a queue over a linked list of parts, each known by its first byte."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[i], end[end[i]]))

        while queue:
            _, i, middle, stop = heapq.heappop(queue)
            if end[i] != middle or end[middle] != stop:  # either part is gone or has grown
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of tokens of each slice) of bytes cut at ``begins``."""
        cuts = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pc.dictionary_encode(pieces)
        own, cache = [], self.cache
        for p in coded.dictionary.to_pylist():
            ids = cache.get(p)
            if ids is None:
                ids = self.merge(p)
                if len(p) <= LONG_SLICE:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[p] = ids
            own.append(ids)
        counts = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((i for ids in own for i in ids), np.uint32, int(counts.sum()))
        code = coded.indices.to_numpy()
        each = counts[code]
        return flat[spans((np.cumsum(counts) - counts)[code], each)], each

    def text(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text of any length, a window at a time."""
        out, at, window = [], 0, SLICE_BYTES
        while at < len(data):
            stop = min(at + window, len(data))
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            part, last = data[at:stop], stop == len(data)
            begins = starts(part, np.array([0, len(part)]), ended=last)
            if not last:
                if len(begins) < 2:
                    window *= 2
                    continue
                part, begins = part[: begins[-1]], begins[:-1]
            out.append(self.ids(part, begins)[0])
            at, window = at + len(part), SLICE_BYTES
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def bytes_of(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens' bytes, each from its offset on."""
        size = self.size[ids]
        out = np.zeros(int((offsets + size).max(initial=0)), np.uint8)
        out[spans(offsets, size)] = self.blob[spans(self.first[ids], size)]
        return out


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] places, then the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


# ---------------------------------------------------------------- the operators


def blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive items of ``data``, by their bounds in bytes."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.view(np.uint8))]).cast(pa.binary())


def encode(df: DataFrame, ranks: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, offsets): ids and the first byte of each token, both as little-endian unsigned 32-bit integers."""
    path, kind = ranks or default_ranks(), df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                if len(data) > SLICE_BYTES:
                    ids = bpe.text(data)
                    count = np.array([len(ids)])
                else:
                    begins = starts(data, bounds)
                    ids, each = bpe.ids(data, begins)
                    upto = np.append(0, np.cumsum(each))[np.searchsorted(begins, bounds)]
                    count = np.diff(upto)
                size = bpe.size[ids]
                at = np.cumsum(size) - size - np.repeat(bounds[:-1], count)
                ends = 4 * np.append(0, np.cumsum(count))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(count.astype(np.int64)), blobs(ids.astype("<u4"), ends), blobs(at.astype("<u4"), ends)], ["id", "n_tokens", "ids", "offsets"])

    out = df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids binary, offsets binary")
    return out.withColumnRenamed("id", id)


def decode(df: DataFrame, ranks: str | None = None, id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns to keep, decoded binary) of (id, ids, offsets)."""
    path = ranks or default_ranks()
    names = [id, *keep]
    fields = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            offsets = batch.column(len(names) + 1)
            for a, b, data, bounds in slices(batch.column(len(names))):
                ids = np.frombuffer(data.tobytes(), "<u4")
                at = np.frombuffer(b"".join(x or b"" for x in offsets[a:b].to_pylist()), "<u4").astype(np.int64)
                size = np.append(0, np.cumsum(bpe.size[ids]))[bounds // 4]  # bytes of the texts before
                out = bpe.bytes_of(ids, at + np.repeat(size[:-1], np.diff(bounds) // 4))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), blobs(out, size)], [*names, "decoded"])

    return df.select(*names, "ids", "offsets").mapInArrow(lean(run), ", ".join([*fields, "decoded binary"]))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents")).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(encoded, keep=("n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
