"""Whitening, byte-level BPE and the source audit, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken

from usagelens.llm import byte_bpe, divergence, entries, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening


def plain_whitening(rows, k=16):
    """By the covariance's eigenvectors: (n, {component: share}, {(id, component): whitened}, {id: deviation})."""
    kept = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, m = len(fit), np.array(fit, float)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    e, vectors = np.linalg.eigh(np.cov(m.T, bias=True))
    e, vectors = e[::-1], vectors[:, ::-1]
    white = {(i, j + 1): float((np.array(x) - m.mean(0)) @ vectors[:, j] / np.sqrt(e[j])) for i, x in kept for j in range(min(k, len(e)))}
    return n, e / e.sum(), white, {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_whitening_equals_the_covariance_way(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    monkeypatch.setattr(whitening, "STEP_ROWS", 50)
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32).tolist()
    data[7:40] = [data[6]] * 33  # a common vector
    data[50] = [x * 100 for x in data[50]]  # wider integers
    rows = list(enumerate(data)) + [(1000, None), (1001, [1.0] * 19 + [None]), (1002, [float("nan")] * 20), (1003, [float("inf")] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as component", "'z' as n", "2 as x", "3 as length").repartition(7)
    got = whitening.whitened(df).collect()
    n, share, white, deviation = plain_whitening(rows)
    assert len(got) == 300 * 16 and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    for c in range(1, 17):
        mine = [r.whitened for r in sorted((r for r in got if r.component == c), key=lambda r: r.vec_id)]
        want = [white[i, c] for i in range(300)]
        assert min(np.abs(np.array(mine) - s * np.array(want)).max() for s in (1, -1)) < 1e-6


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert of([]) == [] and of([(1, None), (2, [])]) == []
    alone = of([(None, [1.0, 2.0]), (3, [1.0, 2.0])])
    assert len(alone) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in alone)
    few = of([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (9, [1.0])])  # ragged, repeated, two of three without spread
    assert len(few) == 9 and {r.n for r in few} == {2}
    assert sorted(abs(r.whitened) for r in few if r.component == 1) == pytest.approx([1, 1, 1]) and all(r.whitened is None for r in few if r.component > 1)
    far = of([(1, [6e16, 0.0]), (2, [-6e16, 1.0]), (3, [0.0, 5.0])])  # sums and squares beyond a long
    assert all(r.deviation is None for r in far if r.vec_id < 3) and all(r.identity_error < 1e-4 for r in far)


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.loaded(byte_bpe.default_ranks()).ranks, special_tokens={})


PIECES = [*"  \n\t\r'''strevmldSTxyz019!?.-", "\x1c", "\x85", " ", "　", "é", "中", "́", "😀", "'re", "'ll", "'ve", "'s", "Ɽ", "\x00", "٣", "²", "Ᲊ", "<|endoftext|>"]


def test_boundaries_are_the_patterns(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    bounds = np.append(0, np.cumsum([len(r) for r in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)
    bpe = byte_bpe.loaded(byte_bpe.default_ranks())
    begins = byte_bpe.starts(data, bounds)
    ids, each = bpe.ids(data, begins)
    upto = np.append(0, np.cumsum(each))[np.searchsorted(begins, bounds)]
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_scan_equals_the_automaton_step_by_step():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 1000, 70_001):
        classes = rng.integers(0, 11, n).astype(np.uint8)
        state, want = byte_bpe.START, []
        for c in classes.tolist():
            want.append(state)
            state = byte_bpe.step(state, c)[0]
        assert byte_bpe.states(classes).tolist() == want


def test_long_texts_by_windows_and_long_slices_by_the_queue(library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(200)) for _ in range(100)]
    texts += ["ab" * 2000 + " " * 999 + "\n" + "!?" * 700, "é" * 1500, "x" * 3000 + " y", " " * 500, "".join(rng.choice("abcde") for _ in range(4000))]
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 60)
    bpe = byte_bpe.loaded(byte_bpe.default_ranks())
    for t in texts:
        assert bpe.text(np.frombuffer(t.encode(), np.uint8)).tolist() == library.encode_ordinary(t)


def test_byte_bpe_round_trip_with_offsets(spark, library):
    rows = [(1, "It's what they'll say: don't!  \n\n Well…"), (2, None), (3, ""), (1, "It's"), (None, "é" * 4000), (7, "word " * 400_000), (8, "\n'" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as offsets", "2 as n_tokens", "3 as decoded")
    got = byte_bpe.decode(encoded := byte_bpe.encode(df), keep=("ids", "offsets", "n_tokens")).collect()
    assert len(got) == len(rows) and encoded.limit(0).count() == 0 and byte_bpe.encode(df.limit(0)).count() == 0
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((i, (t or "").encode()) for i, t in rows)
    for r in got:
        ids, at = np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.offsets, "<u4").tolist()
        whole = bytes(r.decoded)
        assert ids == library.encode_ordinary(whole.decode()) and len(ids) == r.n_tokens
        assert all(whole[a:b] == library.decode_bytes([i]) for i, a, b in list(zip(ids, at, [*at, len(whole)][1:], strict=True))[:500])


def test_op12_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in byte_bpe.op12_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


# ---------------------------------------------------------------- the audit


def plain_audit(rows, least, terms=50):
    documents, own, whole, groups = defaultdict(set), Counter(), Counter(), {(lang or "", source or "") for lang, source, _ in rows}
    for i, (lang, source, text) in enumerate(rows):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            documents[lang or "", t].add(i)
            own[lang or "", source or "", t] += 1
            whole[lang or "", t] += 1
    kept = defaultdict(list)
    for (lang, t), ids in documents.items():
        if len(ids) >= least:
            kept[lang].append(t)
    p = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    out = set()
    for lang, source in groups:
        ts, v = kept[lang], len(kept[lang])
        of = lambda s, t: p(own[lang, s, t], sum(own[lang, s, x] for x in ts), v)  # noqa: B023, E731
        pairs = [(-sum(abs(of(source, t) - of(s, t)) for t in ts), s) for x, s in groups if x == lang and s != source]
        q = {t: p(whole[lang, t], sum(whole[lang, x] for x in ts), v) for t in ts}
        best = [(q[t] - of(source, t), t) for t in ts if own[lang, source, t] and of(source, t) > q[t]]
        for part, items in (("pair", pairs), ("term", best)):
            ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))[: terms if part == "term" else None]
            out |= {(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_audit_equals_the_plain_way(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "HELD_ROWS", 60)
    rng = random.Random(tile)
    words = ["the", "The", "of", "é", "Éa", "naïve", "x", "don't", "1", "中文"] + [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), rng.choice(["web", "book", None, "a", "b", "c", "forum"]), " ".join(rng.choice(words[: rng.choice([6, 36])]) for _ in range(rng.randint(0, 30)))) for _ in range(400)]
    rows += [("en", "web", None), ("fr", "alone", "bonjour"), ("it", "x", "ciao"), ("it", "y", "12 34"), ("en", "silent", "12"), *[("en", "web", "the the the")] * 30]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as n", "3 as rank", "cast(null as long) as doc_id").repartition(5)
    got = divergence.audit(df, least=5, terms=7, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 5, 7)
    assert divergence.audit(df.limit(0)).count() == 0


def test_rates_of_counts_beyond_a_longs_product():
    n = np.array([0, 5, 10**15])
    assert divergence.rates(n, np.array([2 * 10**15] * 3), 7).tolist() == [1 + 10**9 * (x + 5) // (2 * 10**15 + 35) for x in n.tolist()]


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.sql(f"select {', '.join(names)} from ({entries.SQL['op13_divergence']})").fetchall()
    assert sorted(map(tuple, divergence.op13_divergence(spark, SF).select(names).collect())) == sorted(want) and want


def test_each_task_scans_one_bucket_of_all_tiles(spark, monkeypatch):
    """Tasks emit as many partial sums each, so that more tasks don't make one of them emit more."""
    held, scanned = [], divergence.scanned
    monkeypatch.setattr(divergence, "scanned", lambda rows: held.append(rows) or scanned(rows))
    rows = [(lang, f"s{i % 9}", f"a b c{i % 5}") for lang in ("en", "de", "fr") for i in range(60)]
    divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least=5, tile=4).count()
    parts = held[0].rdd.mapPartitions(lambda rs: [sorted({(r.lang, r.lo, r.hi, r.bucket) for r in rs})]).collect()
    assert [{b for *_, b in p} for p in parts] == [{i} for i in range(4)] and len(set(map(len, parts))) == 1
