"""Operators: vectors made by hand and properties."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import batching, evaluate, kmeans, prompts, relational as R, seams, sequence, stats, vectors, vocab
from voxtable.plans import pipelines


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_index_and_slices(spark):
    df = spark.createDataFrame([(x,) for x in np.random.default_rng(0).permutation(1000).tolist()], "v long").repartition(7)
    indexed = R.with_index(df, "v")
    assert rows(indexed, "idx", "v") == [(i, i) for i in range(1000)]
    assert rows(R.slice_rows(indexed, 10, 5), "idx", "v") == [(i, 10 + i) for i in range(5)]
    assert R.slice_rows(indexed, 990, 0).count() == 10 and R.slice_rows(indexed, 990, 50).count() == 10
    assert rows(R.shard_slice(indexed, 3, 300), "idx", "v")[:2] == [(0, 600), (1, 601)]


def test_bounds_and_top_k(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, nan), (1, 0.0), (2, -1.0), (3, 5.0)], "idx long, v double")
    assert rows(R.within(df, {"v": 0}), "idx") == [(1,), (3,)] and rows(R.within(df, most={"v": 0}), "idx") == [(1,), (2,)]
    assert R.within(df).count() == 4
    assert [r.idx for r in R.top_k(df, "v", 2).collect()] == [3, 1] and [r.idx for r in R.top_k(df, "v", 1, False).collect()] == [2]
    assert R.top_k(df, "v", 0).count() == 4 and R.top_k(df, None, 2).count() == 4 and R.top_k(df, "v", 9).count() == 4
    assert [r.idx for r in R.random_k(df, 2).collect()] == [r.idx for r in R.random_k(df.repartition(3), 2).collect()]


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "k string, v string, idx long")
    assert rows(R.lookup(df, table, "k", "v"), "k", "v") == [("a", "y"), ("b", "")]
    assert rows(R.not_empty(R.lookup(df, table, "k", "v"), "v"), "k") == [("a",)]
    assert rows(R.missing_keys(df, table, "k"), "k") == [("b",)]
    assert rows(R.strict_lookup(df.where("k = 'a'"), table, "k", "v"), "v") == [("y",)]
    with pytest.raises(Exception, match="not in the table"):
        R.strict_lookup(df, table, "k", "v").collect()


def test_zips_and_places(spark):
    a, b = (spark.createDataFrame([(i, c + str(i)) for i in range(n)], f"idx long, {c} string") for c, n in (("a", 3), ("b", 2)))
    assert rows(R.zip_join(a, b, lang="de"), "a", "b", "lang") == [("a0", "b0", "de"), ("a1", "b1", "de")]
    with pytest.raises(Exception, match="differ in length"):
        R.zip_exact(a, b).collect()
    assert R.zip_exact(a, a.withColumnRenamed("a", "c")).count() == 3
    assert rows(R.by_place(b, 4, b=""), "idx", "b") == [(0, "b0"), (1, "b1"), (2, ""), (3, "")]
    assert rows(R.concat(a, a), "idx", "a") == [(i, f"a{i % 3}") for i in range(6)]
    assert R.cube(a, b).count() == 6


def test_splits(spark):
    df = spark.createDataFrame([("train",), ("train_covost",), ("dev_covost",)], "split string")
    assert R.split_rows(df, "train", 2).count() == 2 and R.split_rows(df, "dev", 2).count() == 0 and R.split_rows(df, "dev", 1).count() == 1
    assert R.check_pair("en", "de", {2: ["de"]}, 2) == ("en", "de")
    for pair in (("fr", "de"), ("en", "fr")):
        with pytest.raises(ValueError):
            R.check_pair(*pair, {2: ["de"]}, 2)


def test_drop_bad(spark):
    df = spark.createDataFrame([([("human", "x"), ("gpt", "y")],), ([("human", ""), ("gpt", "y")],), ([("human", None)],)], "conversations array<struct<`from`:string,value:string>>")
    assert R.drop_bad_conversations(df).count() == 1


def test_runs_agree(spark):
    values = np.random.default_rng(1).integers(0, 3, 200).tolist()
    long = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, i int, v int")
    want = [v for i, v in enumerate(values) if i == 0 or values[i - 1] != v]
    kept = sequence.collapse_runs(long, ["k"], ["i"], "v")
    assert [r.v for r in kept.orderBy("i").collect()] == want
    assert sequence.collapse_runs(kept, ["k"], ["i"], "v").count() == len(want)


def test_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 4, 5])], "place long, n long")
    assert rows(batching.budget_batches(df, "n", 6), "place", "batch") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    lengths = np.random.default_rng(2).integers(1, 50, 500).tolist()
    df = batching.length_rank(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "idx long, n long"), "n")
    made = {}
    for place, n, b in rows(batching.budget_batches(df, "n", 300), "place", "n", "batch"):
        made.setdefault(b, []).append((place, n))
    assert [p for b in sorted(made) for p, _ in made[b]] == list(range(500))
    for b in sorted(made)[:-1]:
        ns = [n for _, n in made[b]]
        assert max(ns) * len(ns) >= 300 and max(ns[:-1], default=0) * (len(ns) - 1) < 300
    shards = spark.createDataFrame([(i, 1.0) for i in range(7)], "idx long, h double")
    assert [s for _, s in rows(batching.total_shards(shards, "h", 3), "idx", "shard")] == [0, 0, 0, 1, 1, 1, 2]
    assert batching.until_total(shards, "h", 2.5).count() == 3
    monkeypatch.setattr(batching, "BLOCK_ROWS", 2)
    assert rows(batching.until_total(shards, "h", 4.5), "idx") == [(k,) for k in range(5)] and batching.until_total(shards.where("idx < 0"), "h", 1).count() == 0
    assert rows(batching.fixed_batches(shards, 3, "idx"), "idx", "batch")[3] == (3, 1)


def test_runs_over_ranges(spark):
    """One key has most rows and goes over all ranges; nulls are values, null keys are keys."""
    rng = np.random.default_rng(9)
    data = [(None if k % 50 == 0 else "hot" if k % 3 else f"k{k % 7}", k, [None, "a", "b"][int(rng.integers(0, 3))]) for k in range(900)]
    want, last = [], {}
    for key, k, v in data:
        if key not in last or last[key] != v:
            want.append(k)
        last[key] = v
    got = sequence.collapse_runs(spark.createDataFrame(data, "key string, i long, v string").repartition(6), ["key"], ["i"], "v")
    assert sorted(r.i for r in got.collect()) == want and got.columns == ["key", "i", "v"]


def test_early_stopping(spark):
    values = [5, 4, 4, 3, 3.5, 3.2]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "step int, v double")
    assert [r.stop for r in sequence.early_stopping(df, "step", "v", 2).orderBy("step").collect()] == [False] * 5 + [True]
    stop = kmeans.Stop(0, {"inertia": 2})
    history = [{"step": k, "inertia": float(v)} for k, v in enumerate(values)]
    assert [stop.now(history[: k + 1]) for k in range(6)] == [False] * 5 + [True]
    assert [kmeans.Stop(0, {"calinski_harabasz": 0}).now([{"calinski_harabasz": x} for x in seen]) for seen in ([1], [1, 2], [1, 2, 2])] == [False, False, True]
    assert kmeans.Stop(0.1).now([{"step": 1}, {"step": 2, "delta": 0.05}]) and not kmeans.Stop(0.1).now([{"step": 1}])
    assert [r.stop for r in sequence.early_stopping(df, "step", "v", 0).orderBy("step").collect()] == [False, False, True, True, True, True]


def test_adaptive_draws():
    """Short sources are drawn more often, in proportion; those that run out are opened again."""
    draws, opened = sequence.AdaptiveDraws({"a": 1.0, "b": 1.0}, alpha=0.5), []
    sources = {"a": lambda: opened.append("a") or iter([4.0] * 3), "b": lambda: opened.append("b") or iter([1.0] * 5)}
    seen = list(itertools.islice(sequence.adaptive_draws(sources, lambda x: x, draws), 2000))
    share = sum(name == "b" for name, _ in seen) / 2000
    assert 0.76 < share < 0.84 and opened.count("a") > 100 and math.isclose(draws.shares()["b"], 0.8, rel_tol=1e-6)
    fresh = sequence.AdaptiveDraws({"a": 1.0}, 0.02)
    fresh.seen("a", 10.0)
    assert math.isclose(fresh.averages["a"], 1.18)
    with pytest.raises(ValueError, match="empty"):
        next(sequence.adaptive_draws({"a": list}, float, sequence.AdaptiveDraws({"a": 1.0})))


def test_greedy_batches_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[int(rng.integers(0, 2))], i, float(rng.integers(0, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, idx long, v double").repartition(5)
    want_budget, want_total = {}, {}
    for k in "ab":
        batch, longest, count, shard, total = 0, 0.0, 0, 0, 0.0
        for _, i, v in (r for r in rows if r[0] == k):
            longest, count, total = max(longest, v), count + 1, total + v
            want_budget[i], want_total[i] = batch, shard
            if longest * count >= 900:
                batch, longest, count = batch + 1, 0.0, 0
            if total >= 70:
                shard, total = shard + 1, 0.0
    assert {r.idx: r.batch for r in batching.budget_batches(df, "v", 900, ["k"], ["idx"]).collect()} == want_budget
    assert {r.idx: r.shard for r in batching.total_shards(df, "v", 70, ["k"], ["idx"]).collect()} == want_total
    by_length = sorted(rows, key=lambda r: (-r[2], r[1]))
    want = {r[1]: n for k in "ab" for n, r in enumerate(x for x in by_length if x[0] == k)}
    assert {r.idx: r.place for r in batching.length_rank(df, "v", ["k"], descending=True).collect()} == want


def test_averages(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 4, 7])], "k string, i int, v double")
    want = 1.0
    for v in (10, 4, 7):
        want = 0.98 * want + 0.02 * v
    for out in (sequence.moving_average(df, "k", ["i"], "v"), sequence.moving_average(df, "k", ["i"], "v", block=2)):
        assert math.isclose(out.first().avg, want)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in (0, 3, 7)])
    return spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)], "idx long, vec array<double>, label int"), x


def test_nearest(spark, points):
    df, x = points
    book = kmeans.codebook(spark, x[[0, 50, 90]])
    d = ((x[:, None] - x[[0, 50, 90]][None]) ** 2).sum(-1)
    for f in (vectors.assign(df, book, "vec"), vectors.assign_blocks(df, book, "vec", rows=7), vectors.assign_long(df, book, "vec", "idx", blocks=2)):
        got = f.orderBy("idx").collect()
        assert [r.k for r in got] == d.argmin(1).tolist() and np.allclose([r.distance for r in got], d.min(1))
    tie = vectors.assign(df.limit(1), kmeans.codebook(spark, np.zeros((3, 4))), "vec").first()
    assert tie.k == 0


def test_clustering_scores(points):
    df, x = points
    label = np.arange(120) // 40
    c = np.array([x[label == k].mean(0) for k in range(3)])
    s = [np.linalg.norm(x[label == k] - c[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    ch = (sum(40 * ((c[k] - x.mean(0)) ** 2).sum() for k in range(3)) / 2) / (sum(((x[label == k] - c[k]) ** 2).sum() for k in range(3)) / 117)
    assert math.isclose(vectors.davies_bouldin(df, "label", "vec").first()[0], db) and math.isclose(vectors.calinski_harabasz(df, "label", "vec").first()[0], ch)
    cov = np.zeros((4, 4))
    for i, j, v in vectors.covariance(df, "vec").collect():
        cov[i, j] = v
    assert np.allclose(cov, np.cov(x.T, bias=True))


def test_kmeans(spark, points):
    df, x = points
    centers = sorted(tuple(np.round(r.center, 1)) for r in kmeans.fit(df, "vec", 3).collect())
    assert [round(c[0]) for c in centers] == [0, 3, 7]
    batches = [sorted(r.idx for r in b.collect()) for b in kmeans.batches_of(df, ["idx"], 50)]
    assert batches == [list(range(k, min(k + 50, len(x)))) for k in range(0, len(x), 50)]
    model, _ = kmeans.fit_batches([b for _ in range(4) for b in kmeans.batches_of(df, ["idx"], 50)], "vec", x[[0, 50, 90]], check_every=2)
    assert sorted(np.round(model.centers[:, 0]).tolist()) == [0, 3, 7] and model.frames > 120
    # the same updates, one vector set after another, in NumPy
    centers, counts = x[[0, 50, 90]].astype(float).copy(), np.zeros(3)
    for k in range(0, len(x), 50):
        near = ((x[k : k + 50, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(3):
            mine = x[k : k + 50][near == c]
            counts[c] += len(mine)
            centers[c] += (mine.sum(axis=0) - len(mine) * centers[c]) / max(counts[c], 1)
    once, _ = kmeans.fit_batches(kmeans.batches_of(df, ["idx"], 50), "vec", x[[0, 50, 90]])
    assert np.allclose(once.centers, centers) and once.counts.tolist() == counts.tolist()
    saved = []
    opened = {name: (lambda size=size: kmeans.batches_of(df, ["idx"], size), weight) for name, size, weight in (("a", 40, 1.0), ("b", 60, 2.0))}
    joint, history = kmeans.fit_joint(opened, "vec", x[[0, 50, 90]], most_frames=300, validation=df, check_every=2, stop=kmeans.Stop(0, {"inertia": 30}), save=lambda step, book: saved.append(step))
    assert joint.frames >= 300 > 120 and [h["step"] for h in history] == [float(s) for s in saved] != [] and {"inertia", "davies_bouldin", "calinski_harabasz"} <= set(history[0])
    files = df.withColumn("file", F.when(F.col("idx") < 70, "x").otherwise("y"))
    assert sorted(b.count() for b in kmeans.batches_of(files, ["idx"], 50, "file")) == sorted([50, 20, 50, len(x) - 120] if len(x) > 120 else [50, 20, len(x) - 70])


def test_vocabulary(spark):
    old = spark.createDataFrame([(0, "x", -9.0), (1, "y", -10.0)], "rank long, piece string, score double")
    new = R.with_index(vocab.new_types(spark.createDataFrame([("c",), ("y",)], "piece string"), old), "piece")
    got = vocab.extend(old, ["a", "b"], new).orderBy("rank").collect()
    assert [(r.rank, r.piece, r.score) for r in got[2:]] == [(2, "a", -11.0), (3, "b", -12.0), (4, "c", -13.0)]
    assert {r.score for r in vocab.extend(old, ["a"], new, "unigram").where("rank > 1").collect()} == {0.0}
    emb = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(5)], "id long, vec array<float>")
    assert rows(vocab.extend_embeddings(emb, 8), "id") == [(i,) for i in range(8)]
    assert vocab.extend_embeddings(emb, 8, strategy="default").where("id = 7").first().vec == [0.0, 0.0]


def test_edits_of_many_words(spark):
    many = [f"w{i}" for i in range(140_000)]
    changed = [*many[:70_000], "x", *many[70_001:70_010], *many[70_011:]]
    pairs = [(0, " ".join(many), " ".join(changed)), (1, "a b", "a c d"), (2, " ".join(many), ""), (3, None, " ".join(many)), (4, " ".join(many), None)]
    df = spark.createDataFrame(pairs, "idx long, ref string, hyp string")
    assert {r.idx: r.e for r in df.select("idx", evaluate.edits("ref", "hyp").alias("e")).collect()} == {0: 2, 1: 2, 2: 140_000, 3: None, 4: None}


def test_word_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.choices("xyz", k=rng.randrange(9)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert evaluate.word_distance(a, b) == row[-1]


def test_scores(spark):
    df = spark.createDataFrame([(0, "the cat sat", "the bat sat down"), (1, "a b", "a b"), (2, "", "x")], "idx long, ref string, hyp string")
    assert df.orderBy("idx").select(evaluate.edits("ref", "hyp")).collect()[0][0] == 2
    out = evaluate.word_errors(df, "ref", "hyp").first()
    assert (out.edits, out.ref_words) == (3, 5) and math.isclose(out.wer, 0.6)
    assert evaluate.word_errors(df, "ref", "ref").first().wer == 0
    assert evaluate.word_errors(df.where("idx = 2"), "ref", "hyp").first().wer is None
    text = spark.createDataFrame([(0, "a b c d e", "a b c d x")], "idx long, ref string, hyp string")
    want = 100 * math.exp((math.log(4 / 5) + math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2)) / 4)
    assert math.isclose(evaluate.bleu(text, "ref", "hyp").first().bleu, want)
    assert evaluate.bleu(text, "ref", "ref").first().bleu == pytest.approx(100) and 0 < evaluate.chrf(text, "ref", "hyp").first().chrf < 100
    assert stats.corpus_stats(df, length="idx").first().std_idx == pytest.approx(np.std([0, 1, 2]))


def test_plans_and_seams(spark):
    corpus = spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(6)], "idx long, text string, q double")
    units = spark.createDataFrame([(i, f"u{i}\n") for i in range(6)], "idx long, value string")
    left = pipelines.training_rows(corpus, units, least={"q": 2}, top=("q", 2, True))
    made, summary = pipelines.training_set(left, "S: {dsu_seq}", {"dsu_seq": F.col("dsu_seq")}, "text", ["q"])
    assert [(r.idx, r.conversations[0]["value"], r.conversations[1]["value"]) for r in made.collect()] == [(5, "S: u5", "t5"), (4, "S: u4", "t4")]
    assert summary.first().mean_q == 4.5
    audio = spark.createDataFrame([(0, [0.1] * 640), (1, [])], "idx long, audio array<double>")
    feats = seams.encode(audio, "fake", column="audio", dim=2)
    assert [len(r.features) for r in feats.orderBy("idx").collect()] == [2, 0]
    frames = feats.select("idx", F.posexplode("features").alias("t", "feat")).withColumn("mask", F.lit(True))
    lines = pipelines.unit_lines(frames, kmeans.codebook(spark, np.zeros((1, 2))), 2).orderBy("idx").collect()
    assert [r.units for r in lines] == [chr(983040), ""]
    said = seams.score(seams.generate(prompts.prompts(corpus, "{x}\n", {"x": F.col("text")}), lambda: seams.fake_generator("instruction")), lambda: seams.fake_scorer("hypothesis"))
    assert [r.hypothesis for r in said.orderBy("idx").collect()] == [f"t{i}" for i in range(6)]


def slow_bleu(pairs, orders: int = 4) -> float:
    """Corpus BLEU of (reference, hypothesis) token lists."""
    logs = 0.0
    for n in range(1, orders + 1):
        grams = lambda t: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))  # noqa: E731, B023
        matches = sum((grams(r) & grams(h)).total() for r, h in pairs)
        logs += math.log(matches / sum(grams(h).total() for _, h in pairs))
    r, h = (sum(len(p[k]) for p in pairs) for k in range(2))
    return 100 * min(1.0, math.exp(1 - r / h)) * math.exp(logs / orders)


def test_bleu_of_sentence_pieces(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [("The quick brown fox jumps over the lazy dog.", "The quick brown fox jumped over a lazy dog"), ("Rain fell on the harbour all night long.", "Rain fell on the harbour for all of the night."), ("One", "One")]
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "idx long, r string, h string")
    with open(path, "rb") as f:
        got = evaluate.bleu(df, "r", "h", tokenizer=evaluate.sentence_pieces(f.read())).first().bleu
    assert math.isclose(got, slow_bleu([[processor.encode(x, out_type=str) for x in t] for t in texts]))
    assert math.isclose(evaluate.bleu(df, "r", "h").first().bleu, slow_bleu([[x.split() for x in t] for t in texts]))
