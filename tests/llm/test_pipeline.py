"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import hashlib
import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def lowest_of_groups(rows: dict[int, str]) -> set[int]:
    sets, root = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i for i in ids if find(i) == i}


def without_repeats(rows: dict[int, str], length: int = 100) -> dict[int, str]:
    seen, out = set(), {}
    for i in sorted(rows):
        raw = (rows[i] or "").encode()
        keep = bytearray(b"\x01" * len(raw))
        for a in range(len(raw) - length + 1):
            if (piece := raw[a : a + length]) in seen:
                keep[a : a + length] = bytes(length)
            seen.add(piece)
        out[i] = bytes(b for b, k in zip(raw, keep, strict=True) if k).decode("utf-8", "ignore")
    return out


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, fourth = kept.values()
    assert set(second) == lowest_of_groups(first)
    cut = without_repeats(second)
    assert {i: t or "" for i, t in third.items()} == cut
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert set(fourth) == {i for i, t in third.items() if not hit(t)}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(first)) >= 0.95 * len(good)

    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(last) == set(fourth)
    for i, text in fourth.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert last[i].n_tokens == len(ids)
        assert last[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_jaccard_stage_decides_by_row(spark):
    """Repeated and null ids: a copy goes, a row of its own under the same id stays."""
    t, u = "the first text of several words that is long enough to have shingles", "quite another one with nothing in common but also with enough words in it"
    rows = [(3, t, 1), (5, t, 2), (5, u, 3), (None, u + " end of it all that goes on for many more words than before", 4), (7, t, 5), (3, t, 6), (8, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "1 as _order", "2 as _gone")
    out = corpus_pipeline.jaccard_join(spark, df, SF)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, t), (5, u), rows[3][:2], (8, None), (8, "")]))


def test_stages_on_odd_rows(spark):
    """Null, empty, repeated and id-less rows, and columns named like the operators' own, through each stage."""
    long = "a passage of some length that is said again word for word in another text, so that suffixes meet, one and all "
    rows = [(1, long * 2, "en"), (1, long, "en"), (None, None, None), (None, "", "en"), (2, "   ", "de"), (3, "one two", None), (3, "one two", None), (4, "é" * 200, "fr"), (None, long + "and more", "en")]
    names = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, names).selectExpr("*", "'s' as source", "cast(length(text) as bigint) as n_chars", "1 as _key", "2 as _order", "'h' as _hits", "3 as score", "4 as _gone", "5 as component_id", "6 as bucket", "7 as starts")
    sf = SF
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
        kept[name] = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    given = sorted(((i, t) for i, t, _ in rows), key=str)
    assert all(r in given for r in kept["quality_classifier"])
    # Null ids first, then the least text: of the copies of the passage one stays, of equal rows one, and wordless rows all.
    assert sum(bool(t and t.startswith("a passage")) for _, t in kept["jaccard_join"]) < 3 and kept["jaccard_join"].count((3, "one two")) == 1
    assert [r for r in kept["jaccard_join"] if not (r[1] or "").strip()] == [r for r in given if not (r[1] or "").strip()]
    cut = kept["suffix_array_dedup"]
    assert len(cut) == len(rows) and [i for i, _ in cut if i is None] == [None] * 3 and (None, None) in cut
    assert max(len(t or "") for _, t in cut) < 2 * len(long) and sum((t or "").count("said again") for _, t in cut) == 1
    assert kept["benchmark_decontamination"] == given
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(rows) and {r.decoded_sha256 for r in last if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
