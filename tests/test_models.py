"""Nearest neighbours, Ward clustering, language profiles and discriminative learners against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, discriminative, embedding, forests, gold, languages, learning, neighbours
from millrace.sources import binary_vectors, readers, sinks

ROWS = "id long, label string, vector array<double>"


def points(seed, n, dims=3, centres=5):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 5, (centres, dims))
    return [(i, f"c{i % centres}", [float(x) for x in at[i % centres] + rng.normal(0, 0.7, dims)]) for i in range(n)]


def plain_nearest(queries, targets, skip_own=False):
    out = {}
    for i, _, v in queries:
        best = min(((math.dist(v, w), j) for j, _, w in targets if not (skip_own and i == j)), default=None)
        if best:
            out[i] = (best[1], round(best[0], 9))
    return out


@pytest.mark.parametrize(("block", "pivots"), [(1024, 8), (4, 6), (3, 1)])
def test_nearest_is_exact(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    targets = points(1, 90) + [(200, "x", [0.0, 0.0, 0.0]), (201, "y", [0.0, 0.0, 0.0])] + [(300 + i, "hot", [9.0, 9.0, 9.0 + i / 1000]) for i in range(40)]
    queries = points(2, 50) + [(500, None, [0.0, 0.0, 0.0]), (501, None, [100.0, -100.0, 3.0])]
    q, t = spark.createDataFrame([*queries, (900, "n", None)], ROWS), spark.createDataFrame([*targets, (901, "n", None)], ROWS)
    got = {r.id: (r.nearest, round(r.distance, 9)) for r in neighbours.nearest(q, t, "id", "id", most_pivots=pivots).collect()}
    assert got == plain_nearest(queries, targets) and got[500][0] == 200
    own = {r.id: (r.nearest, round(r.distance, 9)) for r in neighbours.nearest(t, t, "id", "id", most_pivots=pivots, skip_own=True).collect()}
    assert own == plain_nearest(targets, targets, True)
    labels = {r.id: r.pred for r in neighbours.nearest_label(q, t, "id", "label", most_pivots=pivots).collect()}
    assert labels == {i: dict((j, name) for j, name, _ in targets)[j] for i, (j, _) in got.items()}


def test_nearest_writes_no_row_for_each_cell(spark, monkeypatch):
    """Random vectors of many columns, of which distances from pivots rule out none: what is written stays in proportion to the rows."""
    rows = np.random.default_rng(4).normal(size=(300, 48))
    sizes, before = [], neighbours.written

    def counted(table, name):
        out = before(table, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    t = spark.createDataFrame([(i, "x", v) for i, v in enumerate(rows.tolist())], ROWS)
    got = {r.id: r.nearest for r in neighbours.nearest(t, t, "id", "id", most_pivots=64, skip_own=True).collect()}
    apart = ((rows[:, None] - rows[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    assert got == dict(enumerate(apart.argmin(1).tolist())) and max(sizes) <= 300


def test_nearest_of_nothing(spark):
    some = spark.createDataFrame(points(1, 3), ROWS)
    assert neighbours.nearest(some, some.limit(0), "id", "id").count() == 0
    assert neighbours.nearest(some.limit(0), some, "id", "id").count() == 0
    assert neighbours.nearest(some.limit(1), some.limit(1), "id", "id", skip_own=True).count() == 0


def plain_ward(rows):
    """Merges one at a time: {id: (into, height, size)}."""
    clusters = {i: (1, np.array(v)) for i, _, v in rows}
    out = {}
    while len(clusters) > 1:
        ids = sorted(clusters)
        height, a, b = min((math.sqrt(2 * clusters[a][0] * clusters[b][0] / (clusters[a][0] + clusters[b][0])) * math.dist(clusters[a][1], clusters[b][1]), a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
        (n, x), (m, y) = clusters[a], clusters.pop(b)
        clusters[a] = (n + m, (n * x + m * y) / (n + m))
        out[b] = (a, round(height, 8), n + m)
    return out


@pytest.mark.parametrize(("last", "block"), [(2048, 1024), (2, 1024), (7, 5)])
def test_ward(spark, monkeypatch, last, block):
    monkeypatch.setattr(clustering, "LAST", last)
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = points(3, 45)
    table = spark.createDataFrame([*rows, (99, "n", None)], ROWS)
    tree = clustering.ward(table, "id", "vector")
    want = plain_ward(rows)
    assert {r.id: (r.into, round(r.height, 8), r["size"]) for r in tree.collect()} == want
    for k in (1, 2, 5, 45):
        kept = sorted(want, key=lambda i: (-want[i][1], -want[i][2], -i))[k - 1 :]
        label = {}
        for i, _, _ in rows:
            at = i
            while at in kept:
                at = want[at][0]
            label[i] = at
        got = {r.id: r.cluster for r in clustering.cut(table, tree, "id", k).collect()}
        assert got == {**label, 99: None} and len(set(label.values())) == k
    if last == 2048:
        assert clustering.best_k(table.where("id < 99"), "id", "vector", [2, 4, 5, 6]) == 5


def test_ward_joins_pass_no_vectors_through_the_driver(spark, monkeypatch):
    """What a round joins is shuffled, and its merges are written before the next: the last plan only reads tables."""
    monkeypatch.setattr(clustering, "LAST", 2)
    seen, kept = {}, clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, name: seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    assert clustering.ward(spark.createDataFrame(points(3, 45), ROWS), "id", "vector").count() == 44
    assert not [name for name, plans in seen.items() for plan in plans if "Broadcast" in plan]
    assert "Join" not in seen["dendrogram"][0] and len(seen["merges"]) > 1


def shuffled(spark, run):
    """Bytes that a run writes to shuffles, and its result."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    out = run()
    return sum(n for stage, n in stages().items() if stage not in before), out


def test_ward_shuffles_no_vector_for_each_block_it_meets(spark, monkeypatch):
    """What is shuffled stays in proportion to the rows: four times the rows met sixteen times as many blocks, each shuffled with its vectors."""
    monkeypatch.setattr(clustering, "BLOCK", 4)
    sizes = []
    for n, last in ((128, 100), (512, 400)):  # one round or two
        monkeypatch.setattr(clustering, "LAST", last)
        rows = np.random.default_rng(5).normal(size=(n, 48)).tolist()
        table = spark.createDataFrame([(i, "x", v) for i, v in enumerate(rows)], ROWS).repartition(4).localCheckpoint()
        size, count = shuffled(spark, lambda t=table: clustering.ward(t, "id", "vector").count())
        assert count == n - 1
        sizes.append(size)
    assert sizes[1] < 6 * sizes[0]


def test_ward_scores_grow_with_the_rows(spark, monkeypatch, tmp_path):
    """The query whole: four times the vectors shuffle some four times the bytes, and cuts have the clusters asked for."""
    from millrace.plans.queries import QUERIES

    monkeypatch.setattr(clustering, "BLOCK", 4)
    sizes = []
    for n, last in ((128, 100), (512, 400)):
        monkeypatch.setattr(clustering, "LAST", last)
        rows = np.random.default_rng(6).normal(size=(n, 48)).tolist()
        spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        size, found = shuffled(spark, lambda n=n: QUERIES["ward_scores"](spark, f"{tmp_path}/{n}").collect())
        assert sorted((r.k, r.clusters, r.rows) for r in found) == [(k, k, n) for k in (2, 4, 8, 16, 32)] and sum(r.is_best for r in found) == 1
        sizes.append(size)
    assert sizes[1] < 6 * sizes[0]


def test_ward_merges_copies_at_once(spark, monkeypatch):
    """Copies of a vector are joined before the rounds, in the order of their keys, with the sequential result."""
    monkeypatch.setattr(clustering, "LAST", 7)
    rounds, kept = [], clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, name: rounds.append(name) or kept(df, name))
    rows = [*points(3, 20), *((100 + 3 * i, "copy", [1.0, 2.0, 4.0]) for i in range(12)), *((101 + 3 * i, "copy", [-1.0, 0.5, 0.25]) for i in range(5))]
    tree = clustering.ward(spark.createDataFrame(rows, ROWS), "id", "vector")
    assert {r.id: (r.into, round(r.height, 8), r["size"]) for r in tree.collect()} == plain_ward(rows)
    assert rounds.count("chosen") < 8  # one copy in a round needed eleven


def test_ward_meets_in_either_precision():
    """Far from the origin, and where single precision tells nothing apart, choices are those of plain distances."""
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(60, 5)) + 1e4, rng.normal(size=(60, 5)) * 1e-30, np.vstack([rng.normal(size=(59, 5)) * 1e-4, np.full((1, 5), 1e5)]), np.eye(60)):
        n = np.sort(rng.integers(1, 4, 60))  # packs are in the order of n
        packs = []
        for block, at in enumerate((np.arange(0, 25), np.arange(25, 60))):
            pack = clustering._Pack.__new__(clustering._Pack)
            pack.block, pack.ids, pack.n, pack.x, pack.other, pack.height = block, at, n[at], x[at], at, np.full(len(at), np.inf)
            pack.asks = np.isinf(pack.height)
            packs.append(pack)
        known = [clustering._Known(p) for p in packs]
        for i, j in ((0, 0), (0, 1), (1, 1)):
            clustering._meet(packs[i], packs[j], np.arange(len(packs[i].ids)), np.arange(len(packs[j].ids)), known[i], known[j], 8)
        d = np.sqrt(2 * n[:, None] * n[None] / (n[:, None] + n[None]) * ((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        assert np.concatenate([k.other for k in known]).tolist() == d.argmin(1).tolist()
        assert np.allclose(np.concatenate([k.height for k in known]), d.min(1), rtol=1e-12)


def test_ward_of_few_rows(spark):
    table = spark.createDataFrame(points(1, 2), ROWS)
    assert clustering.ward(table.limit(0), "id", "vector").count() == 0
    assert clustering.ward(table.limit(1), "id", "vector").count() == 0
    assert clustering.ward(table, "id", "vector").count() == 1


def test_languages(spark):
    rng = random.Random(1)
    words = {"en": ["the", "kettle", "with", "handle", "and", "lid", "of", "steel"], "de": ["der", "kessel", "mit", "griff", "und", "deckel", "aus", "stahl"], "fr": ["la", "bouilloire", "avec", "poignée", "et", "couvercle", "en", "acier"]}
    rows = [(i, lang, " ".join(rng.choices(words[lang], k=8))) for i in range(60) for lang in [["en", "de", "fr"][i % 3]]] + [(90, None, "x"), (91, "en", None)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    known = languages.profiles(docs)
    assert list(known) == ["de", "en", "fr"] and all(len(w) == languages.BUCKETS for w in known.values())
    asked = spark.createDataFrame([(1, "the lid of the kettle"), (2, "Der Deckel, aus Stahl!"), (3, "avec la poignée"), (4, None), (5, "12 3"), (6, ""), (7, "the handle " * 5000)], "id long, text string")
    got = {r.id: (r.l, r.e) for r in asked.select("id", languages.language(F.col("text"), known).alias("l"), languages.spoken(F.col("text"), known).alias("e")).collect()}
    assert got == {1: ("en", True), 2: ("de", False), 3: ("fr", False), 4: (None, False), 5: (None, False), 6: (None, False), 7: ("en", True)}
    assert languages.profiles(docs.limit(0)) == {}
    with pytest.raises(ValueError, match="languages"):
        languages.profiles(docs, most=1)


def plain_machine(x, y, s, c, steps=4000):
    """Gradient descent with momentum on the squared hinge, for one class."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    rate = 1 / (1 + 2 * c * np.linalg.norm(x * np.sqrt(s)[:, None], 2) ** 2)
    w = before = np.zeros(x.shape[1])
    for t in range(steps):
        at = w + t / (t + 3) * (w - before)
        short = np.maximum(0, 1 - y * (x @ at))
        w, before = at - rate * (at - 2 * c * ((s * short * y) @ x)), w
    return w


@pytest.mark.parametrize("dense", [512, 2])
def test_squared_hinge(spark, monkeypatch, dense):
    monkeypatch.setattr(discriminative, "DENSE", dense)
    rows = [r for r in points(5, 80, 4, 3) if r[1] != "c2" or r[0] % 2]
    table = spark.createDataFrame([*rows, (900, None, [0.0] * 4), (901, "c0", None)], ROWS).repartition(3)
    classes, w = discriminative.squared_hinge(table, "label", "vector", c=0.05)
    assert classes == ["c0", "c1", "c2"]
    x, names = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for j, name in enumerate(classes):
        y = np.where(names == name, 1, -1)
        s = len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
        assert np.abs(plain_machine(x, y, s, 0.05) - w[j]).max() < 1e-4
    got = {r.id: r.pred for r in discriminative.decided(table, "vector", classes, w).collect()}
    assert sum(got[i] == name for i, name, _ in rows) > 0.95 * len(rows) and got[901] is None
    with pytest.raises(ValueError, match="two classes"):
        discriminative.squared_hinge(table.where("label = 'c0'"), "label", "vector")


def test_discriminants(spark):
    rows = points(6, 90, 4, 3)
    x, names = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    found = discriminative.discriminants(spark.createDataFrame(rows, ROWS).repartition(4), "label", "vector")
    assert found.shape == (4, 2)
    within = sum((o := x[names == c] - x[names == c].mean(0)).T @ o for c in set(names)) / len(x)
    assert np.allclose(found.T @ within @ found, np.eye(2), atol=1e-4)
    mean = np.array([x[names == c].mean(0) for c in sorted(set(names))]) - x.mean(0)
    values = np.sort(np.linalg.eigvals(np.linalg.solve(within, mean.T @ mean / 3)).real)[::-1][:2]
    assert np.allclose(np.diag(found.T @ (mean.T @ mean / 3) @ found), values, rtol=1e-3)
    out = discriminative.projected(spark.createDataFrame([*rows[:5], (99, "n", None)], ROWS), "vector", found, "p").collect()
    assert all(np.allclose(r.p, np.array(r.vector) @ found) if r.vector else r.p is None for r in out)


def test_rbf_machine(spark):
    """A ring around a disc: no line parts them, the kernel does."""
    rng = np.random.default_rng(7)
    turn, far = rng.uniform(0, 2 * math.pi, 200), np.where(np.arange(200) % 2, rng.uniform(2, 3, 200), rng.uniform(0, 1, 200))
    rows = [(i, "ring" if i % 2 else "disc", [float(far[i] * math.cos(turn[i])), float(far[i] * math.sin(turn[i]))]) for i in range(200)]
    table = spark.createDataFrame(rows, ROWS)
    make, missed = discriminative.rbf_features(table, "vector", landmarks=60)
    x = np.array([r[2] for r in rows])
    gamma = 1 / (2 * x.var())
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(make(x) @ make(x).T - exact).max() < 0.05 and 0 <= missed < 0.01
    seen = discriminative.mapped(table, "vector", "seen", make)
    classes, w = discriminative.squared_hinge(seen, "label", "seen", c=1.0)
    good = discriminative.decided(seen, "seen", classes, w).where("pred = label").count()
    flat = discriminative.squared_hinge(table, "label", "vector", c=1.0)
    assert good > 195 and discriminative.decided(table, "vector", *flat).where("pred = label").count() < 150


def test_elimination_keeps_what_tells(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"c{i % 2}", [float(rng.normal()), float(3 * (i % 2) + rng.normal() / 2), float(rng.normal())]) for i in range(90)]
    found = discriminative.eliminated(spark.createDataFrame(rows, ROWS), "id", "label", "vector", folds=2, c=1.0)
    assert found[0][0] == [0, 1, 2] and found[-1][0] == [1] and all(good > 0.9 for _, good in found)


def test_entities_are_merged_by_buckets(spark, tmp_path):
    """Late batches, batches that come twice, null keys and values; buckets without news keep their files."""
    path = str(tmp_path / "entities")
    schema = "k string, at int, name string, kind string"
    one = spark.createDataFrame([("a", 2, "A2", None), ("a", 1, "A1", "x"), ("b", 5, None, "y"), (None, 1, "n", None)], schema)
    two = spark.createDataFrame([("a", 3, None, "z"), ("a", 0, "A0", "w"), ("c", 1, "C", None)], schema)
    sinks.merge_entities(one, path, "k", ["at"], buckets=8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "entities").rglob("*.parquet")}
    sinks.merge_entities(two, path, "k", ["at"], buckets=8)
    sinks.merge_entities(one.limit(0), path, "k", ["at"], buckets=8)
    want = {("a", "A2", "z"), ("b", None, "y"), (None, "n", None), ("c", "C", None)}
    assert {tuple(r) for r in sinks.stored_entities(spark, path, "k").collect()} == want
    touched = {r.b for r in two.select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    kept = [p for p in files if int(p.parent.name.split("=")[1]) not in touched]
    assert kept and all(p.stat().st_mtime_ns == files[p] for p in kept)
    sinks.merge_entities(two, path, "k", ["at"], buckets=8)
    sinks.merge_entities(one, path, "k", ["at"], buckets=8)
    assert {tuple(r) for r in sinks.stored_entities(spark, path, "k").collect()} == want


def test_alias_draws_in_proportion():
    w = np.array([5.0, 1.0, 0.5, 3.5])
    share, other = embedding.alias_table(w)
    chance = np.array([share[i] + sum(1 - share[j] for j in range(4) if other[j] == i and j != i) for i in range(4)]) / 4
    assert np.allclose(chance, w / w.sum())


def topics(n, seed=3):
    """Texts of two topics with words of their own."""
    rng = random.Random(seed)
    words = [["kettle", "boil", "steam", "spout", "lid", "tea"], ["tyre", "wheel", "brake", "pedal", "chain", "road"]]
    return [(i, f"t{i % 2}", ["even", "odd"][i // 2 % 2] if i % 5 else None, rng.choices(words[i % 2], k=12) + [["left", "right"][i // 2 % 2]]) for i in range(n)]


def test_cbow(spark):
    """Words of a topic are nearer to each other than to those of the other; reruns agree to the last digit."""
    docs = spark.createDataFrame(topics(160), "id long, topic string, half string, words array<string>").repartition(3)
    make = lambda rows: {r.word: np.array(r.vector) for r in embedding.cbow(rows, "id", dims=16, window=3, passes=6, rate=0.3, parts=3).collect()}
    found = make(docs)
    again = make(docs.repartition(5))
    assert set(found) == {w for r in topics(160) for w in r[3]} and all((found[w] == again[w]).all() for w in found)
    cos = lambda a, b: found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])
    same = np.mean([cos("kettle", w) for w in ("boil", "steam", "spout", "lid", "tea")])
    other = np.mean([cos("kettle", w) for w in ("tyre", "wheel", "brake", "pedal", "chain", "road")])
    assert same > other + 0.3
    assert embedding.cbow(docs.limit(0), "id").count() == 0
    with pytest.raises(ValueError, match="words"):
        embedding.cbow(docs, "id", most_words=3)


def test_cbow_reads_numbers_in_more_parts(spark, monkeypatch):
    """Passes read texts as numbers of known words, in more parts as rows grow."""
    seen, kept = [], embedding.written
    monkeypatch.setattr(embedding, "PART_ROWS", 40)
    monkeypatch.setattr(embedding, "written", lambda df, name: seen.append((dict(df.dtypes)["_ids"], df.select("_part").distinct().count())) or kept(df, name))
    docs = spark.createDataFrame(topics(160), "id long, topic string, half string, words array<string>")
    assert embedding.cbow(docs, "id", dims=4, passes=1, parts=2).count() == 14
    assert seen == [("array<int>", 4)]


def test_heads_share_their_words(spark):
    rows = topics(240)
    docs = spark.createDataFrame([*rows, (900, None, None, ["zzz"]), (901, "t0", "odd", [])], "id long, topic string, half string, words array<string>")
    model = embedding.fit_shared(docs.where("id % 3 <> 0 OR id >= 900"), "id", "words", ["topic", "half"], size=1 << 10, dims=8, passes=8, parts=2)
    assert model.classes == {"topic": ["t0", "t1"], "half": ["even", "odd"]}
    got = {r.id: r for r in embedding.predict_shared(docs, "words", model).collect()}
    asked = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i].pred_topic == t for i, t, _, _ in asked) >= 0.95 * len(asked)
    assert sum(got[i].pred_half == ["even", "odd"][i // 2 % 2] for i, *_ in asked) >= 0.95 * len(asked)
    assert got[901].pred_topic is None and len(got) == len(rows) + 2
    with pytest.raises(ValueError, match="classes"):
        embedding.fit_shared(docs, "id", "words", ["topic"], most_classes=1)
    with pytest.raises(ValueError, match="bytes"):
        embedding.train(docs, "id", {"x": np.zeros((10, 10))}, None, 1, 1, 1, most_bytes=10)


def test_heads_of_rows_that_are_much_alike(spark, monkeypatch):
    """Steps of many equal rows stay finite, and more rows make more parts of the same size."""
    made = [(i, ["large ring", "small cog", "red bolt"][i % 3].split() + ["widget", "item"]) for i in range(600)]
    rows = spark.createDataFrame([(i, w[0], w) for i, w in made], "id long, kind string, words array<string>")
    monkeypatch.setattr(embedding, "PART_ROWS", 100)
    seen, kept = [], embedding.written
    monkeypatch.setattr(embedding, "written", lambda df, name: seen.append(df.select("_part").distinct().count()) or kept(df, name))
    model = embedding.fit_shared(rows, "id", "words", ["kind"], size=1 << 8, dims=8, passes=10, rate=8.0, parts=2)
    assert all(np.isfinite(p).all() for p in model.parameters.values())
    assert embedding.predict_shared(rows, "words", model).where("pred_kind = kind").count() == 600
    assert seen == [6]


def test_corrections_that_are_missing(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, l1 string, l2 string")
    both = spark.createDataFrame([(1, "x", "B"), (2, "y", "z")], "id int, l1 string, l2 string")
    assert sorted(map(tuple, gold.apply_corrections(rows, both, "id", ["l1", "l2"], strict=True).collect())) == [(1, "a", "b"), (2, "y", "z")]
    assert gold.apply_corrections(rows, both.where("id = 1"), "id", ["l1", "l2"]).count() == 1
    with pytest.raises(Exception, match="no correction of 2"):
        gold.apply_corrections(rows, both.where("id = 1"), "id", ["l1", "l2"], strict=True).collect()


def test_files_by_cluster_and_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster_id int, name string")
    sinks.per_cluster(rows, str(tmp_path / "clusters"))
    assert sorted(p.name for p in (tmp_path / "clusters").glob("cluster_id=*")) == ["cluster_id=1", "cluster_id=2"]
    folder = tmp_path / "words"
    folder.mkdir()
    (folder / "kettle_noun.csv").write_text("lid,2.5\nspout,3\nbody,1\n")
    (folder / "big_red_adj.csv").write_text("dark,1\n")
    got = {tuple(r) for r in readers.dictionaries(spark, str(folder), 2).collect()}
    assert got == {("kettle", "noun", "spout", 3.0), ("kettle", "noun", "lid", 2.5), ("big_red", "adj", "dark", 1.0)}


def test_reduction_and_importance(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector, vector_to_array

    table = spark.createDataFrame(points(4, 60, 4, 2), ROWS).select("id", F.col("label").alias("kind"), array_to_vector("vector").alias("features"))
    x = np.array([r[2] for r in points(4, 60, 4, 2)])
    for kind in ("pca", "scale", "minmax"):
        found = np.array([r.v for r in Pipeline(stages=learning.reduced(kind, 2)).fit(table).transform(table).orderBy("id").select(vector_to_array("reduced").alias("v")).collect()])
        if kind == "minmax":
            assert np.allclose(found, (x - x.min(0)) / (x.max(0) - x.min(0)))
        elif kind == "scale":
            assert np.allclose(found, x / x.std(0, ddof=1))
        else:
            s = x / x.std(0, ddof=1)
            assert np.allclose(found.var(0, ddof=1), np.linalg.eigvalsh(np.cov(s.T))[::-1][:2])
    model = learning.fit(table, "rf", "kind", [])
    picked = learning.important(model, 2).transform(model.transform(table))
    assert all(len(r.selected) == 2 for r in picked.collect())


def test_extra_trees(spark):
    """Leaves hold the rows that reach them, classes are told apart by the column that tells, and reruns agree."""
    rng = np.random.default_rng(9)
    rows = [(i, f"c{i % 3}", [float(rng.normal()), float(4 * (i % 3) + rng.normal() / 2), float(rng.normal()), 1.0]) for i in range(150)]
    table = spark.createDataFrame([*rows, (900, None, [0.0] * 4), (901, "c0", None)], ROWS)
    forest = forests.extra_trees(table.repartition(3), "label", "vector", trees=6, depth=5, tried=2)
    again = forests.extra_trees(table.repartition(7), "label", "vector", trees=6, depth=5, tried=2)
    assert (forest.column == again.column).all() and (forest.cut == again.cut).all() and (forest.counts == again.counts).all()
    x, y = np.array([r[2] for r in rows]), np.array([r[0] % 3 for r in rows])
    for t in range(6):
        at = forest.nodes(x, t)
        assert (forest.column[t][at] == -1).all()
        for node in set(at.tolist()):
            assert forest.counts[t][node].tolist() == np.bincount(y[at == node], minlength=3).tolist()
    assert forest.importance.argmax() == 1 and forest.importance[3] == 0 and math.isclose(forest.importance.sum(), 1)
    got = {r.id: r.pred for r in forests.decided(table, "vector", forest).collect()}
    assert sum(got[i] == name for i, name, _ in rows) > 140 and got[901] is None
    assert forests.important(table, "vector", forest, 1).where("id = 0").first().selected == [rows[0][2][1]]
    with pytest.raises(ValueError, match="bytes"):
        forests.extra_trees(table, "label", "vector", depth=20)
    with pytest.raises(ValueError, match="no rows"):
        forests.extra_trees(table.limit(0), "label", "vector")


@pytest.mark.parametrize("split", [64 << 20, 500, 97, 7])
def test_binary_vectors(spark, tmp_path, split):
    """Words of every length, floats that look like words, newlines and blanks inside the floats, any cut."""
    rng = np.random.default_rng(split)
    odd = np.frombuffer(b"\n a \nab \n\nword \n \n x", "<f4")
    rows = [(f"w{'ä' * (i % 40)}{i}", [float(x) for x in (np.resize(odd, 5) if i % 3 else rng.normal(size=5).astype("f4"))]) for i in range(120)]
    table = spark.createDataFrame(rows, "word string, vector array<float>").repartition(3)
    path = str(tmp_path / "vectors")
    assert binary_vectors.write(table, path) == 120
    got = binary_vectors.read(spark, path, split)
    assert sorted((r.word, np.array(r.vector, "f4").tobytes()) for r in got.collect()) == sorted((w, np.array(v, "f4").tobytes()) for w, v in rows)


def test_binary_vectors_of_other_writers(spark, tmp_path):
    plain = b"2 2\nab " + np.array([1, 2], "<f4").tobytes() + b"c " + np.array([3, 4], "<f4").tobytes()
    (tmp_path / "v.bin").write_bytes(plain)
    assert sorted((r.word, list(r.vector)) for r in binary_vectors.read(spark, str(tmp_path / "v.bin"), 9).collect()) == [("ab", [1, 2]), ("c", [3, 4])]
    (tmp_path / "cut.bin").write_bytes(plain[:-3])
    with pytest.raises(Exception, match="no record at byte"):
        binary_vectors.read(spark, str(tmp_path / "cut.bin")).collect()
    (tmp_path / "bad.bin").write_bytes(b"words\n")
    with pytest.raises(Exception, match="head line"):
        binary_vectors.read(spark, str(tmp_path / "bad.bin")).collect()
    for word, vector in (("a b", [1.0]), (None, [1.0]), ("a", None), ("x" * 2000, [1.0])):
        with pytest.raises(Exception, match="no word or vector"):
            binary_vectors.write(spark.createDataFrame([(word, vector)], "word string, vector array<float>"), str(tmp_path / "w"))
    assert binary_vectors.write(spark.createDataFrame([], "word string, vector array<float>"), str(tmp_path / "none")) == 0
