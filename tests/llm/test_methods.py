"""The operators' methods against plain versions of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import common, features, shards, toxicity

SF = "/root/testdata/sf0.1"


def sparse(rows):
    """Rows of {feature: value}; each ends with the statistics, as the machine expects."""
    index, value, start = [], [], [0]
    for r in rows:
        both = list(r.items()) + [(features.DIM - features.STATS + i, 0.5 * i) for i in range(features.STATS)]
        index += [k for k, _ in both]
        value += [v for _, v in both]
        start.append(len(index))
    return features.Sparse(np.array(index, np.int32), np.array(value, np.float32), np.array(start, np.int64))


def test_the_sum_of_squares_is_the_double_sum():
    rng = np.random.default_rng(3)
    x = sparse([{int(i): float(rng.normal()) for i in rng.choice(5000, int(rng.integers(0, 30)), replace=False)} for _ in range(40)])
    m = features.FactorisationMachine(6)
    m.bias, m.w = 0.3, rng.normal(size=len(m.w)).astype(np.float32)
    m.v = rng.normal(0, 0.3, m.v.shape).astype(np.float32)
    got = m.margins(x)[0]
    for r in range(40):
        at = slice(x.start[r], x.start[r + 1])
        i, v = x.index[at], x.value[at].astype(float)
        plain = m.bias + float(m.w[i].astype(float) @ v)
        for a in range(len(i)):
            for b in range(a):
                plain += float(m.v[i[a]].astype(float) @ m.v[i[b]].astype(float)) * v[a] * v[b]
        assert got[r] == pytest.approx(plain, rel=1e-3, abs=1e-3)


def test_chain_learns_later_links_from_out_of_fold_probabilities(monkeypatch):
    """A link that knows the rows it was shown: an out-of-fold probability never comes from a model that saw its row."""
    shown = []

    class Memory:
        def fit(self, x, y, earlier):
            self.rows = {int(i) for i in x.index if i < 1000}
            shown.append((len(self.rows), earlier.copy()))
            return self

        def predict(self, x, earlier):
            own = [int(x.index[a]) for a in x.start[:-1]]
            return np.array([float(r in self.rows) for r in own])

    monkeypatch.setattr(toxicity, "Link", Memory)
    n = 50
    x, folds = sparse([{i: 1.0} for i in range(n)]), np.arange(n) % toxicity.FOLDS
    y = np.column_stack([np.arange(n) % 2, np.arange(n) // 2 % 2]).astype(float)
    chain = toxicity.Chain(["a", "b"]).fit(x, y, folds)
    assert [k for k, _ in shown] == [40] * 5 + [50] + [40] * 5 + [50]
    assert all((e == 0).all() and e.shape[1] == 1 for _, e in shown[6:])  # seen rows would give 1
    assert chain.predict(x).shape == (n, 2) and (chain.predict(x) == 1).all()


def test_toxicity_on_held_out_rows(spark):
    labels = common.table(spark, SF, "labels").where(features.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    rows = toxicity.op7_toxicity(spark, SF).join(labels, "doc_id").collect()
    found = sum(r.toxic and r.label for r in rows)
    assert len(rows) > 500 and sum(r.toxic == r.label for r in rows) / len(rows) >= 0.97
    assert found / sum(r.label for r in rows) >= 0.85 and found / sum(r.toxic for r in rows) >= 0.97


@pytest.mark.parametrize("law", ["rows", "key"])
def test_shards_equal_a_plain_shuffle(spark, law):
    seed, n = 7, 3
    df = spark.createDataFrame([(i, f"text {i % 50} " * (i % 7)) for i in range(400)] + [(None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.shard, r.slot) for r in shards.sharded(df, n, law, seed, bucket_bytes=1500).collect()}
    counts = np.bincount([s for s, _ in got.values()], minlength=n)
    assert law == "key" or counts.max() - counts.min() <= 1
    for s in range(n):
        assert sorted(p for t, p in got.values() if t == s) == list(range(counts[s]))
    hashed = df.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary"))).alias("h"), shards.rendezvous(F.col("doc_id"), n, seed).alias("to")).collect()
    inside = n if law == "key" else 1
    each = -(-sum(len((r.text or "").encode()) + 1 for r in hashed) // (1500 * inside))
    buckets: dict = {}
    for r in hashed:
        buckets.setdefault((r.to if law == "key" else 0) * each + r.h % each, []).append(r)
    assert len(buckets) > 2 * n
    order: list = []
    for b in sorted(buckets):
        own = sorted(buckets[b], key=lambda r: (r.h, r.doc_id is None, r.doc_id or 0))
        picks = np.random.default_rng([seed, b]).integers(0, np.arange(len(own), 0, -1))
        for i in range(len(own) - 1):
            j = i + picks[i]
            own[i], own[j] = own[j], own[i]
        order += [(r, b // each) for r in own]
    at = dict.fromkeys(range(n), 0)
    for place, (r, s) in enumerate(order):
        shard, slot = (place % n, place // n) if law == "rows" else (s, at[s])
        at[s] += 1
        assert got[r.doc_id, r.text] == (shard, slot)


def test_shards_are_written_by_slot(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(30)], "doc_id long, text string")
    shards.write_shards(shards.sharded(df, 3), str(tmp_path / "out"))
    for s in range(3):
        for f in (tmp_path / f"out/shard={s}").glob("*.parquet"):
            slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
            assert slots == sorted(slots)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
