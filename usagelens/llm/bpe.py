"""BPE encoding and decoding by tree concatenation.

A text beyond a leaf is cut in halves wherever its middle falls; the halves are encoded apart (in other tasks where
a text is over ``split_bytes``), then the chunks on both sides of the join are encoded anew in a growing window until
its first chunk is the left half's and its last the right half's. A chunk is what lies between ASCII white space, which the tokenizer must
drop (checked when its file is read). What has no white space may be any length: such a pre-token is a tree of its own, of which the tokens
around each join are encoded anew in the same way. A BPE token sequence is the encoding
of its text exactly if each two neighbours are the encoding of theirs, so the result is the whole text's.

Defined cases: null and empty texts have no tokens and decode to ''. Repeated rows give repeated rows. Extra
columns are neither read nor returned, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import lean, slices, table

#: Longest run that is encoded in one call, in byte-level characters.
LEAF = 512
#: Entries of a worker's cache of white-space-free chunks; it is emptied when full.
CACHE_ENTRIES = 150_000
#: A longer text (UTF-8 bytes) is encoded in segments by several tasks.
SPLIT_BYTES = 64 << 10
SEGMENT_BYTES = 32 << 10

#: Leaves of a text are so many times a pre-token's, as their chunks are encoded one by one.
LEAF_CHUNKS = 8

TEXT, PIECE, PART, LAST_PART = range(4)


def back(raw: bytes, at: int, k: int) -> int:
    """Where the k-th chunk before ``at`` starts (0 if there are fewer)."""
    for size in (64 * k, 1024 * k, at):
        lo = max(0, at - size)
        parts = raw[lo:at].rsplit(None, k)
        if len(parts) > k:  # what is left in front ends where white space before the k-th chunk begins
            end = lo + len(raw[lo:at].rsplit(None, k)[0])
            return end + len(raw[end:at]) - len(raw[end:at].lstrip())
        if lo == 0:
            return 0
    return 0


def ahead(raw: bytes, at: int, k: int) -> int:
    """Where the k-th chunk after ``at`` ends (the end if there are fewer)."""
    for size in (64 * k, 1024 * k, len(raw)):
        part = raw[at : at + size]
        parts = part.split(None, k)
        if len(parts) > k:
            return at + len(part.rstrip()[: len(part.rstrip()) - len(parts[k].rstrip())].rstrip())
        if at + size >= len(raw):
            return len(raw)
    return len(raw)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TreeBPE:
    """A BPE tokenizer file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, leaf: int = LEAF, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.leaf, self.limit = max(2, leaf), cache_entries
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
        self.end = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.token = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        ids = lambda t: self.whole.encode(t, add_special_tokens=False).ids
        if spec.get("decoder") or any(ids(f"ab{x}cd") != ids("ab") + ids("cd") for x in (" ", "\n", " \t\r\x0b\x0c ")):
            raise ValueError("a tokenizer that drops white space and has no decoder is needed")

    # ------------------------------------------------ trees

    def leaf_ids(self, run: str, last: bool) -> list[int]:
        return (self.end if last else self.inner).encode(run, add_special_tokens=False).ids

    def run_ids(self, run: str, last: bool = True) -> list[int]:
        """Tokens of a pre-token (``last``) or of a stretch that another follows."""
        if len(run) <= self.leaf:
            return self.leaf_ids(run, last)
        mid = len(run) // 2
        return self.join(self.run_ids(run[:mid], False), self.run_ids(run[mid:], last), last)

    def chars(self, ids: list[int]) -> str:
        return "".join(t[: -len(self.suffix)] if self.suffix and (t := self.token[i]).endswith(self.suffix) else self.token[i] for i in ids)

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbouring stretches from theirs."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.leaf_ids(self.chars(left[a:]) + self.chars(right[:b]), last and b == len(right))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            k *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """A balanced tree over the stretches of one pre-token, the last of which ends it."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2], i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    # ------------------------------------------------ texts

    def pieces(self, chunk: str) -> Iterator[int | str]:
        """A chunk's special tokens as ids and its pre-tokens as byte-level strings."""
        for part in self.split_special.split(chunk) if self.split_special else [chunk]:
            if part in self.special:
                yield self.special[part]
            elif part:
                norm = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                yield from (p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(norm))

    def chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        """ids and decoded bytes of a stretch without ASCII white space."""
        if len(raw) <= 2 * self.leaf:
            ids = self.whole.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        else:
            ids = []
            for p in self.pieces(raw.decode("utf-8", "replace")):
                ids += [p] if isinstance(p, int) else self.run_ids(p)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return self.whole.decode(ids, skip_special_tokens=False).encode()

    def flat(self, raw: bytes) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each chunk between white space, one after the other."""
        cache, found = self.cache, []
        for c in raw.split():
            got = cache.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= 64:
                    if len(cache) >= self.limit:
                        cache.clear()
                    cache[c] = got
            found.append(got)
        return found

    def halves(self, raw: bytes) -> list[tuple[bytes, bytes]]:
        """The same of a text of any length, cut in halves wherever its middle falls, a leaf's worth at most in one piece."""
        if len(raw) <= self.leaf * LEAF_CHUNKS:
            return self.flat(raw)
        mid = len(raw) // 2
        while raw[mid] & 0xC0 == 0x80:  # a character stays whole
            mid -= 1
        left, right, k = self.halves(raw[:mid]), self.halves(raw[mid:]), 1
        while left and right:
            # The k chunks on each side of the join, encoded anew: done when the first is the left half's and the last the right half's.
            lo, hi = back(raw, mid, k), ahead(raw, mid, k)
            window = self.flat(raw[lo:hi])
            if (k >= len(left) or window[0] == left[-k]) and (k >= len(right) or window[-1] == right[k - 1]):
                return left[:-k] + window + right[k:]
            k *= 2
        return left or right

    def text(self, raw: bytes) -> tuple[bytes, bytes]:
        """ids (little-endian, 32 bits) and decoded UTF-8 of a whole text."""
        found = self.halves(raw)
        return b"".join([x[0] for x in found]), self.joined([x[1] for x in found])

    def joined(self, decoded: list[bytes]) -> bytes:
        """Without a decoder in the file the library puts a blank between any two tokens."""
        return b" ".join([x for x in decoded if x])

    # ------------------------------------------------ segments of very long texts

    def segments(self, raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        """(kind, payload): whole stretches between white space, pre-tokens, or parts of a long pre-token."""
        space = re.compile(rb"[ \t\n\x0b\x0c\r]")
        at = 0
        while at < len(raw):
            if len(raw) - at <= size:
                cut = len(raw)
            else:
                cut = max(raw.rfind(s, at, at + size) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
            if cut > at:
                yield TEXT, raw[at:cut]
                at = cut
                continue
            m = space.search(raw, at)
            stop = m.start() if m else len(raw)
            for p in self.pieces(raw[at:stop].decode("utf-8", "replace")):
                if isinstance(p, int):
                    yield TEXT, self.token[p].encode()
                elif len(p) <= size:
                    yield PIECE, p.encode()
                else:
                    for i in range(0, len(p), size):
                        yield LAST_PART if i + size >= len(p) else PART, p[i : i + size].encode()
            at = stop

    def segment_ids(self, kind: int, payload: bytes) -> bytes:
        if kind == TEXT:
            return self.text(payload)[0]
        return np.asarray(self.run_ids(payload.decode(), kind != PART), "<u4").tobytes()


_loaded: dict[tuple, TreeBPE] = {}


def loaded(path: str, leaf: int) -> TreeBPE:
    if (path, leaf) not in _loaded:
        _loaded[path, leaf] = TreeBPE(path, leaf)
    return _loaded[path, leaf]


SCHEMA = "n_tokens long, ids binary, decoded string"


def encode(df: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id", leaf: int = LEAF, split_bytes: int = SPLIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(id, n_tokens, ids as little-endian 32-bit integers, decoded text) for each row."""
    path = tokenizer or default_tokenizer()
    kind = df.schema[id].dataType.simpleString()
    df = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, leaf)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                got = [bpe.text(raw[offsets[i] : offsets[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([x for x, _ in got], pa.binary()), pa.array([y for _, y in got], pa.binary()).cast(pa.string())], ["id", "n_tokens", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, leaf)
        for batch in batches:
            for row, id_, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, (what, payload) in enumerate(bpe.segments(raw.encode(), segment_bytes)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "id": pa.array([id_], batch.schema.field("id").type), "n": pa.array([n], pa.int32()), "kind": pa.array([what], pa.int32()), "payload": [payload]})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, leaf)
        for batch in batches:
            ids = [bpe.segment_ids(k, p) for k, p in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
            yield batch.set_column(4, "payload", pa.array(ids, pa.binary()))

    def tree(group: pa.Table) -> pa.Table:
        bpe, ids, open_ = loaded(path, leaf), [], []
        group = group.sort_by("n")
        for what, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
            tokens = np.frombuffer(payload, "<u4").tolist()
            if what in (PART, LAST_PART):
                open_.append(tokens)
                if what == LAST_PART:
                    ids += bpe.join_all(open_)
                    open_ = []
            else:
                ids += tokens
        return pa.table({"id": group.column("id")[:1], "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([np.asarray(ids, "<u4").tobytes()], pa.binary()), "decoded": pa.array([bpe.decode(ids).decode()], pa.string())})

    size = F.octet_length("text")
    short = df.filter(size.isNull() | (size <= split_bytes)).mapInArrow(lean(whole), f"id {kind}, {SCHEMA}")
    long = df.filter(size > split_bytes).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    long = long.mapInArrow(lean(cut), f"row long, id {kind}, n int, kind int, payload binary").repartition("row", "n")
    long = long.mapInArrow(lean(each), f"row long, id {kind}, n int, kind int, payload binary").groupBy("row").applyInArrow(tree, f"id {kind}, {SCHEMA}")
    return short.unionByName(long).withColumnRenamed("id", id)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents")))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
