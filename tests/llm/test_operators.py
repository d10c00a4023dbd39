import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelens.llm import bpe, chat, common, decontaminate, fingerprints, induced, jaccard, quality, shards, suffix_dedup, toxicity, urls

SF = "/root/testdata/sf0.001"
ROWS = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "the quick brown fox jumps over the lazy dog again and again today"), (3, None), (4, ""), (5, "one two"), (5, "one two"), (None, "x" * 3000), (7, "é" * 40 + " Ünï")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.selectExpr("*", "'z' as shard", "1 as score", "2 as n_tokens", "cast(length(text) as bigint) as n_chars")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_equals_the_library(spark, docs, empty):
    whole = bpe.TreeBPE(bpe.default_tokenizer()).whole
    for split in (4 << 20, 100):
        got = bpe.encode(docs, leaf=8, split_bytes=split, segment_bytes=50).collect()
        assert len(got) == len(ROWS)
        want = sorted((str(i), tuple(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
        assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
        assert all(r.decoded == whole.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in got)
    assert bpe.encode(empty).count() == 0


def test_tree_concatenation_on_odd_texts():
    b, rng = bpe.TreeBPE(bpe.default_tokenizer(), leaf=4), random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aabcdehinrt'’é́ह一 <|1") for _ in range(rng.randint(0, 90)))
        t = t[:20] + "<|endoftext|>" + t[20:] + "ha" * rng.randint(0, 40)
        assert np.frombuffer(b.text(t.encode())[0], "<u4").tolist() == b.whole.encode(t, add_special_tokens=False).ids


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = i if g not in least else min(least[g], i)
    return sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))


def test_jaccard_equals_brute_force(spark, empty):
    rng, words = random.Random(5), [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(12)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, "   ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num in ((4, 85), (2, 70)):
        got = sorted(tuple(r) for r in jaccard.jaccard_components(df, n, num, 100).collect())
        assert got == brute_components(rows, n, num, 100)
    assert jaccard.jaccard_components(empty.select("doc_id", "text")).count() == 0


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(600):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x) // 8 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 8 + 1)), np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert len(np.intersect1d(jaccard.signatures(x, 85, 100), jaccard.signatures(y, 85, 100)))


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("a", "Quick brown, fox jumps over the lazy dog again and"), ("b", "ONE two"), ("c", None), ("d", "absent words here")], "item_id string, text string")
    for limit in (1 << 20, 1):
        got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs, items, limit_bytes=limit).collect()}
        assert (1, 13, 10, ("a",)) in got and (5, 2, 2, ("b",)) in got and (3, 0, 0, ()) in got
    assert sorted(str(r.doc_id) for r in decontaminate.without_documents(docs, items).collect()) == ["3", "4", "7", "None"]
    assert "the " in {r.text[:4] for r in decontaminate.without_spans(docs, items).where("doc_id = 1").collect()}


def test_decontamination_is_the_same_over_the_limit(spark, docs, empty):
    items = spark.createDataFrame([("a", "Quick brown, fox jumps over the lazy dog again and"), ("b", "ONE two"), ("c", None), (None, "clean text"), ("d", "one TWO"), ("e", "")], "item_id string, text string")
    more = docs.unionByName(spark.createDataFrame([(1, "clean text"), (None, "one two"), (None, "a, one two. b"), (5, None)], "doc_id long, text string").selectExpr("*", "'z' as shard", "1 as score", "2 as n_tokens", "0L as n_chars"))
    more = more.withColumns({"_key": F.lit(1), "_hits": F.lit("h"), "_text": F.lit("t")})
    made = []
    for limit in (1 << 20, 1):
        kept = decontaminate.without_documents(more, items, limit_bytes=limit)
        cut = decontaminate.without_spans(more, items, limit_bytes=limit)
        assert kept.columns == cut.columns == more.columns
        report = decontaminate.report(more, items, limit_bytes=limit)
        made.append([sorted(str(tuple(r)) for r in df.collect()) for df in (kept, cut, report)])
        assert decontaminate.without_documents(empty, items, limit_bytes=limit).count() == 0 and decontaminate.report(docs, items.limit(0), limit_bytes=limit).where("n_hit > 0").count() == 0
    assert made[0] == made[1]
    left = [r for r in more.collect() if not (r.text or "").startswith("the quick") and "one two" not in (r.text or "")]
    assert made[0][0] == sorted(str(tuple(r)) for r in left) and any(r.doc_id == 1 for r in left)
    assert decontaminate.judged("one three", [{"at": 0, "m": 2, "gram": "one two", "items": ["b"]}])[2] == []  # of equal hash alone


def test_shards(spark, docs, empty):
    for law in ("rows", "key"):
        rows = shards.sharded(docs, 3, law).collect()
        assert len(rows) == len(ROWS)
        for s in range(3):
            own = sorted(r.slot for r in rows if r.shard == s)
            assert own == list(range(len(own)))
        if law == "key":
            assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert shards.sharded(empty, 3).count() == 0


def test_suffix_array_levels_and_spills():
    rng = np.random.default_rng(0)
    for _ in range(60):
        t = rng.integers(0, 3, int(rng.integers(1, 90)))
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for memory, base in ((1 << 20, 1 << 20), (5, 0)):
            sa, lcp = induced.suffix_array(t, memory, base)
            assert sa.tolist() == order
            for j in range(1, len(t)):
                a, b, k = t[sa[j - 1] :].tolist(), t[sa[j] :].tolist(), int(lcp[j])
                assert a[:k] == b[:k] and a[k : k + 1] != b[k : k + 1]


def test_repeats_equal_brute_force(spark, empty):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None, 5]), "".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) if rng.random() < 0.8 else rng.choice(["xy" * 150, None])) for _ in range(40)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=12, anchor=5).collect()
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - 11):
            if raw[k : k + 12] in seen:
                gone.update(range(k, k + 12))
            seen.add(raw[k : k + 12])
        want.append((str(i), len(raw), bytes(c for k, c in enumerate(raw) if k not in gone)))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup.repeats(empty).count() == 0


def test_fingerprints(spark, docs):
    rows = {(str(r.doc_id), r.n_chars, bytes(r.fingerprint)) for r in fingerprints.fingerprinted(docs).collect()}
    assert len({f for i, _, f in rows if i in "12"}) == 1
    got = fingerprints.beside_next(docs.where("doc_id in (1, 2, 7)")).collect()
    texts = dict(ROWS)
    for r in got:
        after = {7: 2, 2: 1, 1: 7}[r.doc_id]
        assert r.edited == fingerprints.edited(texts[r.doc_id], texts[after])
    assert {r.near_next for r in got if r.doc_id == 2} == {1.0}


def test_near_groups_equal_brute_force(spark):
    rng = np.random.default_rng(7)

    def changed(x: bytes, each: int) -> bytes:
        """``each`` bytes of every band but the first are other ones."""
        y = np.frombuffer(x, np.uint8).reshape(16, 8).copy()
        for band in y[1:]:
            band[rng.permutation(8)[:each]] += np.uint8(rng.integers(1, 256))
        return y.tobytes()

    hub = rng.integers(0, 256, 128).astype(np.uint8).tobytes()
    far = [changed(hub, 5) for _ in range(3)]  # of the hub's first bucket, not near it nor each other
    prints = [hub, *far, *(changed(x, 1) for x in far for _ in range(3)), far[1], *(rng.integers(0, 256, 128).astype(np.uint8).tobytes() for _ in range(3))]
    ids = [None if i == 9 else i for i in range(len(prints))]
    group = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j, y in enumerate(prints):
            if any(x[k : k + 8] == y[k : k + 8] for k in range(0, 128, 8)) and np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= 0.8:
                group = [group[i] if g == group[j] else g for g in group]
    want = sorted((str(i), min(ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None)) for i, g in zip(ids, group, strict=True))
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in zip(ids, prints, strict=True)], "doc_id int, fingerprint binary")
    got = fingerprints.near_groups(df, width=8, threshold=0.8).collect()
    assert sorted((str(r.doc_id), r.group) for r in got) == want
    assert len(set(group)) == 7


def test_a_fingerprint_has_one_link_at_first(spark, monkeypatch):
    """Near copies share many bands, whose hubs differ; links don't grow with the bands that a pair shares."""
    rng = np.random.default_rng(3)
    base, rows, links, components = rng.integers(0, 256, (32, 4)).astype(np.uint8), [], [], fingerprints.connected_components
    for i in range(60):
        own = base.copy()
        own[rng.permutation(32)[:6]] += np.uint8(1 + i)
        rows.append((i, bytearray(own.tobytes())))
    monkeypatch.setattr(fingerprints, "connected_components", lambda found, *a: links.append(found.count()) or components(found, *a))
    got = fingerprints.near_groups(spark.createDataFrame(rows, "doc_id int, fingerprint binary")).collect()
    assert {r.group for r in got} == {0} and len(got) == 60
    assert links[0] <= 59


def test_parts_of_fingerprints_lose_no_near_pair():
    """Parts are equal where bytes are, and tell most pairs apart that share only a band."""
    rng = np.random.default_rng(1)
    a, other = (rng.integers(0, 256, (2000, 128)).astype(np.uint8) for _ in range(2))
    b = np.where(rng.random((2000, 128)) < rng.random((2000, 1)) * 0.6, a, other)
    x, y = (pd.Series([r.tobytes() for r in z]) for z in (a, b))
    parts = fingerprints.likeness_of_parts(fingerprints.parts_of(x), fingerprints.parts_of(y))
    assert np.array_equal(parts, ((a & 7) == (b & 7)).mean(1)) and (parts >= fingerprints.likeness(x, y)).all()
    other[:, :4] = a[:, :4]
    chance = fingerprints.likeness_of_parts(fingerprints.parts_of(x), fingerprints.parts_of(pd.Series([r.tobytes() for r in other])))
    assert (chance >= fingerprints.NEAR).mean() < 0.02


def test_release_waits_for_what_python_let_go_of(spark):
    """Else Spark keeps the exchanges of frames that are gone."""
    told = spark.sparkContext._gateway._gateway_client.finalizer_deque
    frames = [spark.range(3) for _ in range(20)]
    common.released(spark)
    del frames
    assert told
    common.released(spark)
    assert not told


def test_near_groups_find_edited_texts(spark):
    """Recall over texts with 1 % of their characters edited, and no clean text in another's group."""
    rng = random.Random(5)

    def changed(x):
        x = list(x)
        for _ in range(max(1, len(x) // 100)):
            i, kind = rng.randrange(len(x)), rng.randrange(3)
            x[i : i + (kind != 1)] = [rng.choice("abcdefgh ")] * (kind != 2)
        return "".join(x)

    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 200 and 5000").dropDuplicates(["text"]).orderBy("doc_id").limit(200).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, changed(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    group = {r.doc_id: r.group for r in fingerprints.near_groups(fingerprints.fingerprinted(df)).collect()}
    assert len(group) == 400
    assert sum(group[i] == group[1000 + i] for i in range(200)) >= 180


def test_fingerprints_of_odd_rows(spark, empty):
    rows = [("b", "x"), ("a", "y" * 3000), (None, None), ("b", "x"), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as node", "2 as bucket")
    got = fingerprints.grouped(fingerprints.beside_next(df)).collect()
    assert len(got) == 5 and {r.doc_id: r.n_chars for r in got} == {"b": 1, "a": 3000, None: 0, "c": 0}
    assert len({bytes(r.fingerprint) for r in got if r.doc_id == "b"}) == 1
    assert fingerprints.grouped(fingerprints.beside_next(empty)).count() == 0


def test_op8_against_plain_python(spark):
    from usagelens.llm import entries

    docs_ = sorted(((r.doc_id, r.text or "") for r in common.table(spark, SF, "documents").collect()), reverse=True)
    after = {docs_[i][0]: docs_[(i + 1) % len(docs_)][1] for i in range(len(docs_))}
    texts, got = dict(docs_), entries.queries()["op8_fingerprints"](spark, SF).collect()
    assert len(got) == len(docs_)
    by_text = {}
    for r in got:
        t, k = texts[r.doc_id], len(texts[r.doc_id]) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[r.doc_id][:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, (r.fingerprint, r.group_id)) == (r.fingerprint, r.group_id)


def test_shards_of_clashing_columns_and_another_cluster(spark, docs):
    df = docs.selectExpr("*", "1 as _h", "2 as _bucket", "3 as slot")
    one = {(str(r.doc_id), r.text, r.shard, r.slot) for r in shards.sharded(df, 3).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert {(str(r.doc_id), r.text, r.shard, r.slot) for r in shards.sharded(df, 3).collect()} == one
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {"_h", "_bucket"} <= set(shards.sharded(df, 3).columns)


def test_induced_sorting_spills_and_recurses():
    rng = np.random.default_rng(1)
    induced.counters.update(spills=0, levels=0)
    for n in (1, 2, 10, 300, 3000):
        for k in (1, 2, 4, 200):
            t = rng.integers(0, k, n)
            order, lcp = induced.suffix_array(t, 50, 20)
            raw = bytes(t.tolist())
            want = sorted(range(n), key=lambda i: raw[i:])
            assert order.tolist() == want
            same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905, E731
            assert lcp.tolist()[1:] == [same(raw[a:], raw[b:]) for a, b in zip(want[:-1], want[1:], strict=True)]
    assert induced.counters["spills"] > 0 and induced.counters["levels"] >= 2


def test_suffix_dedup_spills_in_its_own_path(monkeypatch):
    """With memory small against a part, the sorting inside the operator spills and recurses, and the result is brute force's."""
    rng = random.Random(2)
    base = "".join(rng.choice("abcd") for _ in range(3000)).encode()
    texts = [base[i : i + 900] + bytes([97 + i % 5]) + base[i + 100 : i + 500] for i in range(0, 1500, 130)]
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: induced.suffix_array(t, 200, 50))
    induced.counters.update(spills=0, levels=0)
    starts = [len(t) - 99 for t in texts]
    which, window = suffix_dedup.earlier(texts, starts, np.arange(len(texts)), np.zeros(len(texts), np.int64), 100)
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            (want.add((i, j)) if t[j : j + 100] in seen else seen.add(t[j : j + 100]))
    assert set(zip(which.tolist(), window.tolist(), strict=True)) == want and want
    assert induced.counters["spills"] > 0 and induced.counters["levels"] >= 2


def test_a_part_is_sorted_in_few_bytes_of_memory_a_byte():
    """An executor holds a part for each core, beside Spark's own memory."""
    rng = np.random.default_rng(3)
    texts = [bytes(x) for x in rng.integers(97, 105, (4000, 300)).astype(np.uint8)]
    texts += [x[:200] + y[200:] for x, y in zip(texts[:2000], texts[2000:4000], strict=True)]
    seen, want = set(), []
    for i, x in enumerate(texts):
        for w in range(201):
            if x[w : w + 100] in seen:
                want.append((i, w))
            seen.add(x[w : w + 100])
    tracemalloc.start()
    which, window = suffix_dedup.earlier(texts, [201] * len(texts), np.arange(len(texts)), np.zeros(len(texts), np.int64), 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(which.tolist(), window.tolist(), strict=True)) == want
    assert peak < 40 * sum(map(len, texts))


def test_suffix_dedup_of_repeated_and_odd_ids(spark):
    rows = [("b", "p" + "x" * 150), ("a", "q" + "x" * 150), (None, "r" + "x" * 150), ("b", "p" + "x" * 150), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as _order", "2 as _starts")
    got = suffix_dedup.repeats(df).collect()
    # Of all runs of x one byte stays, in the row without an id, which comes first; the second of two equal rows goes whole.
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == [("None", b"rx"), ("a", b"q"), ("b", b""), ("b", b"p"), ("c", b"")]
    assert suffix_dedup.without_repeats(df).columns == df.columns


def test_models_score_all_rows(spark, docs, empty):
    d, l = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality.train(d, l)
    assert quality.scored(docs, model).where("score between 0 and 1").count() == len(ROWS)
    assert quality.kept(empty, model).count() == 0
    assert quality.scored(docs, quality.train(d, l.limit(0))).select("score").distinct().first()[0] == 0.5
    chain = toxicity.train(d, l, toxicity.CATEGORIES)
    assert toxicity.scored(docs, chain).where("toxic between 0 and 1 and low_quality between 0 and 1").count() == len(ROWS)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op6_quality(spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.9


def first_lines(turns):
    """(id, number, role) of each true turn's first line with a word."""
    out = set()
    for r in turns.collect():
        at = next((i for i, x in enumerate(r.lines) if x.strip()), None)
        if at is not None:
            out.add((r.conv_id, r.turn * chat.TURN_LINES + at, r.role))
    return out


def test_chat_on_held_out_conversations(spark, monkeypatch):
    turns = chat.transcripts(common.table(spark, "/root/testdata/sf0.01", "conversations"))
    out = chat.held_out(turns["conv_id"])
    raw, model = chat.raw_lines(turns.where(out)), chat.train(turns.where(~out))
    assert raw.columns == ["conv_id", "number", "line"]  # nothing tells the turns apart
    found = lambda: {(r.conv_id, r.number, r.role) for r in chat.parsed(raw, model).collect() if not r.continues}
    one, want = found(), first_lines(turns.where(out))
    assert len(one & want) >= 0.9 * max(len(one), len(want)) and len(want) > 50
    monkeypatch.setattr(chat, "BLOCK", 2 << 32)
    assert found() == one


def test_chat_keeps_lines(spark):
    answer = "An answer.\n\n  Q: quoted, not asked\nA: and so on\n\n\nThe end."
    said = [("user", "User: What is it?", "What is it?"), ("assistant", "Assistant: " + answer, answer), ("user", "User: And\n\n this? ", "And\n\n this? "), ("assistant", "AI: " + answer + "\n", answer), ("user", None, None)]
    rows = [(c, i, role, raw) for c in range(20) for i, (role, raw, _) in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.turn_lines(F.col("text"), F.col("turn") > 0).alias("lines"))
    got = chat.parsed(chat.raw_lines(turns), chat.train(turns)).collect()
    want = {(c, role, text) for c in range(20) for role, _, text in said if text}
    assert {(r.conv_id, r.role, r.text) for r in got} == want and len(got) == 80
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>" and not r.continues for r in got)
    odd = spark.createDataFrame([(None, 1, "User: a"), (None, 1, "User: a"), (None, 2, None), (5, None, " "), (5, 3, "Assistant: b")], "conv_id long, number long, line string").selectExpr("*", "1 as block", "2 as parted")
    assert sorted((str(r.conv_id), r.role, r.text) for r in chat.parsed(odd, chat.train(turns)).collect()) == [("5", "assistant", "b"), ("None", "user", "a"), ("None", "user", "a")]
    assert chat.parsed(odd.limit(0), chat.train(turns.limit(0))).count() == 0


def test_urls_reach_unruled_branches_and_deep_paths(spark):
    rows = [f"http://a{i % 4}.example.org/{x}/{i}" for i in range(40) for x in ("es", "fr")] + [f"https://shop.net/{x}/{i}" for i in range(5) for x in ("es", "fr")] + ["https://shop.net/" + "/".join("abcdefghij") + f"/{i}" for i in range(4)] * 2 + ["http://x.com" + "/y" * 500, None, "x"]
    df = spark.createDataFrame([(None if i == 3 else i, u) for i, u in enumerate(rows)], "page_id long, url string").selectExpr("*", "'z' as host", "1 as rate", "2 as path")
    got = urls.judged(df).collect()
    assert len(got) == len(rows)
    of = lambda start: {(r.rule, r.verdict) for r in got if (r.host + r.path).startswith(start)}
    assert of("shop.net/es/") == {(None, "block")} and of("shop.net/fr/") == {(None, "allow")}
    assert of("a1.example.org/es/") == {("example.org/es/", "block")}
    assert len({r.rate for r in got if r.host == "shop.net"}) > 1
    few = {r.page_id: (r.rule, r.verdict) for r in got}
    many = urls.RULES + [("block", f"n{i}.example/x/") for i in range(urls.FEW_RULES)]
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judged(df, many).collect() if r.rule} == {k: v for k, v in few.items() if v[0]}
    assert urls.judged(df.limit(0)).count() == 0


def test_merging_keeps_branches_apart_that_the_test_tells_apart(spark):
    kids = [("h", "", f"good{i}", 30, 0) for i in range(5)] + [("h", "", f"bad{i}", 0, 30) for i in range(5)] + [("h", "", "mixed", 15, 15), ("h", "", "few", 0, 1)]
    got = {r.segment: r.token for r in urls.branches(spark.createDataFrame(kids, "host string, prefix string, segment string, good long, bad long")).collect()}
    assert len(got) == 12 and len({got[f"good{i}"] for i in range(5)}) == 1 and len({got[f"bad{i}"] for i in range(5)}) == 1
    assert got["few"] == got["bad0"] and len(set(got.values())) == 3


def test_urls(spark):
    rows = [(1, "http://A.Example.org/en/12?x"), (2, "https://x.com/fr/1"), (3, "https://x.com/de/1"), (4, "nothing"), (5, None), (6, "http://example.org/es/2"), (7, "http://org.net")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4][:3] == got[5][:3] == ("", "", None)
    assert got[6][2] == "example.org/es/" and got[7][2] is None


def test_digest_of_op3_has_the_contract_columns(spark):
    from usagelens.llm import entries

    r = entries.queries()["op3_decontamination"](spark, SF)
    assert r.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert hashlib.sha256(b"").hexdigest() in {x.items_sha256 for x in r.collect()}
