import random
from difflib import SequenceMatcher

from usagelens.config import Config
from usagelens.functions import similar
from usagelens.plans import text

SF = "/root/testdata/sf0.01"


def altered(rng: random.Random, t: str, n: int) -> str:
    for _ in range(n):
        k = rng.randrange(len(t) + 1)
        t = t[:k] + rng.choice(["", "x", "the", "é"]) + t[k + rng.randint(0, 2) :]
    return t[:200]


def prompts(rng: random.Random) -> list[str]:
    words = ["the", "of", "ation", "ing", "zoé", "queue", "x", "her", "an"]
    base = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([3, 20, 50, 70, 120])))[:200] for _ in range(14)]
    return list({t for _ in range(160) if (t := altered(rng, rng.choice(base), rng.randint(0, 25)))} | {"pf. " * 50, "a"})


def test_tile_equals_all_pairs(monkeypatch):
    ts = prompts(random.Random(4))
    want = {(x, y): r for x in ts for y in ts if (r := SequenceMatcher(None, x, y).ratio()) >= 0.8}
    assert len(want) > 2 * len(ts)
    for sub, few in ((2048, 8), (37, 0)):
        monkeypatch.setattr(similar, "SUB", sub)
        monkeypatch.setattr(similar, "FEW", few)
        for left, right in ((ts, None), (ts[:70], ts[70:])):
            got = {((right or left)[j], left[i]) if turned else (left[i], (right or left)[j]): r for i, j, turned, r in similar.tile(left, right, 0.8)}
            assert got == {k: r for k, r in want.items() if right is None or (k[0] in left) != (k[1] in left)}


def test_a_block_is_made_once_and_met_once(monkeypatch):
    """Both orders of two blocks' texts go by one product of the blocks, however many blocks a tile has."""
    made, met, block, near = [], [], similar.Block, similar.near
    monkeypatch.setattr(similar, "SUB", 50)
    monkeypatch.setattr(similar, "Block", lambda *a: made.append(1) or block(*a))
    monkeypatch.setattr(similar, "near", lambda x, y, t: met.append(1) or near(x, y, t))
    ts = [t + str(i) for i in range(10) for t in prompts(random.Random(i))[:30]]
    list(similar.tile(ts[:150], ts[150:], 0.8))
    assert (len(made), len(met)) == (6, 9)
    list(similar.tile(ts[:150], None, 0.8))
    assert (len(made), len(met)) == (9, 15)


def test_texts_longer_than_the_bit_vector(monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh \0é") for _ in range(n)) for n in (150, 199, 200, 260, 400)]
    ts = list({t for b in base for _ in range(12) if (t := "".join(c for c in b if rng.random() > 0.07))})
    for few in (0, 8):
        monkeypatch.setattr(similar, "FEW", few)
        want = {(i, j): r for i, x in enumerate(ts) for j, y in enumerate(ts) if (r := SequenceMatcher(None, x, y).ratio()) >= 0.8}
        assert {(j, i) if turned else (i, j): r for i, j, turned, r in similar.tile(ts, None, 0.8)} == want


def test_pairs_that_differ_at_the_start(spark, monkeypatch):
    monkeypatch.setattr(text, "BLOCK_TEXTS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    d = docs.select("doc_id", "lang", text.F.substring(text.normalised("text"), 1, 200).alias("p")).where("length(p) > 0").collect()
    want = {(a.doc_id, b.doc_id): round(r, 6) for a in d for b in d if a.lang == b.lang and a.doc_id < b.doc_id and (s := SequenceMatcher(None, a.p, b.p)).quick_ratio() >= 0.8 and (r := s.ratio()) >= Config().similarity}
    got = text.similar_pairs_join({"documents": docs}).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want
    assert {(1, 255), (2, 56), (56, 332)} <= set(want)


def test_repeats_join_the_earliest_near_prompt(spark):
    import hashlib

    rng, rows = random.Random(6), []
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(130)) for _ in range(5)]
    for i in range(120):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(t))
            t = t[:k] + "q" + t[k + 1 :]
        rows.append((i if i != 50 else None, rng.choice(["s", "t", None]), t + "!"))
    want, reps = {}, {}
    for i, source, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t[:-1]
        own = reps.setdefault(source, [])
        rep = next((r for r in own if SequenceMatcher(None, r[:100], t[:100]).ratio() >= 0.9), None)
        if rep is None:
            own.append(rep := t)
        want[source, hashlib.md5(rep.encode()).hexdigest()] = want.get((source, hashlib.md5(rep.encode()).hexdigest()), 0) + 1
    got = text.user_prompt_repeats({"documents": spark.createDataFrame(rows, "doc_id long, source string, text string")}).collect()
    assert {(r.source, r.prompt_key): r.n for r in got} == {k: n for k, n in want.items() if n >= 2} and len(got) > 10
    assert max(map(len, reps.values())) > 5


def test_token_pairs_leave_the_join_near_and_once(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, rng.randint(1, 20)) for _ in range(12)]
    rows = [(i, rng.choice(["en", "de", None]), " ".join(w for w in rng.choice(base) if rng.random() > 0.08)) for i in range(150)]
    sets = {i: (lang, set(t[:200].split(" "))) for i, lang, t in rows if lang}
    want = {(a, b): round(r, 6) for a, (k, s) in sets.items() for b, (m, o) in sets.items() if a < b and k == m and (r := len(s & o) / len(s | o)) >= Config().similarity}
    df = text.token_jaccard_pairs({"documents": spark.createDataFrame(rows, "doc_id long, lang string, text string")})
    got = df.collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 100
    assert "Aggregate [x#" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_one_length_meet_by_their_rarest_grams(monkeypatch):
    """Pairs of texts of the greatest length come from the index, those of other lengths too, none is lost and few others are looked at."""
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoinshrdlu   bcdfgkmpvw") for _ in range(260)) for _ in range(60)]
    ts = list({t[: rng.choice([200, 200, 200, 150])] for b in base for _ in range(4) for t in ["".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in b)]} | {"der " * 50, "das " * 50})
    want = {(i, j): r for i, x in enumerate(ts) for j, y in enumerate(ts) if (r := SequenceMatcher(None, x, y).ratio()) >= 0.8}
    looked, shared = [], similar.shared
    monkeypatch.setattr(similar, "shared", lambda x, y, i, j: looked.append(len(i)) or shared(x, y, i, j))
    for sub, hits in ((2048, 1 << 22), (37, 50)):
        monkeypatch.setattr(similar, "SUB", sub)
        monkeypatch.setattr(similar, "HITS", hits)
        assert {(j, i) if turned else (i, j): r for i, j, turned, r in similar.tile(ts, None, 0.8)} == want
    assert any(i != j for i, j in want) and similar.Block(ts, 4).probes(0.8)[2] and sum(looked) < len(ts) ** 2 / 5
    ids = similar.np.array([rng.sample(range(len(ts)), len(ts))] * 2)
    got = {(j, i) if turned else (i, j): r for i, j, turned, r in similar.tile(ts, None, 0.8, [ids])}
    assert got == {(i, j): r for (i, j), r in want.items() if ids[0][i] <= ids[0][j]}


def test_whole_texts_are_normalised_once(spark):
    """Their prompts are kept, not made anew for each side of the pairs."""
    docs = spark.createDataFrame([(i, "en", "s", "one two three " * 9 + "!" * i) for i in range(4)], "doc_id long, lang string, source string, text string")
    for query in (text.similar_pairs_join, text.near_dup_prompt_join):
        df = query({"documents": docs})
        assert df.count() == 6 and "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_token_pairs_are_those_of_whole_texts(spark):
    """Texts that are alike in their first 200 characters alone are no pair, those that differ there alone are one."""
    start, rest = ([f"{c}{i}" for i in range(n)] for c, n in (("start", 30), ("rest", 400)))
    rng, rows = random.Random(8), [start + rest, start + [f"o{i}" for i in range(400)], [f"s{i}" for i in range(30)] + rest]
    rows += [[w for w in start + rest if rng.random() > 0.1] for _ in range(12)]
    sets = [set(r) for r in rows]
    want = {(a, b): round(r, 6) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (r := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8}
    got = text.token_jaccard_pairs({"documents": spark.createDataFrame([(i, "en", " ".join(r)) for i, r in enumerate(rows)], "doc_id long, lang string, text string")}).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) and (0, 2) in want and (0, 1) not in want
