"""Jaccard join, components and the pipeline against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import connected, mixing, ngram_join, pieces
from millrace.llm.queries import PIECES_MODEL
from tests.conftest import DATA
from tests.llm.test_small_operators import plain_line_dedup

AWKWARD = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "É one two"), (8, "é one two"), (9, "a b c d"), (9, "a b c d"), (9, "x y z"), (None, "a b c d"), (10, "a b c d " * 3000)]


def shingles(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words, percent):
    """(id, set size, smallest id reached) of each row, sorted."""
    sets = [(i, frozenset(shingles(t, words))) for i, t in rows]
    owner = {}
    for i, s in sorted(sets, key=lambda x: x[0]):
        owner.setdefault(s, i)
    different = [s for s in owner if s]
    links = {s: [] for s in different}
    for x, s in enumerate(different):
        for t in different[x + 1 :]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                links[s].append(t)
                links[t].append(s)
    root = {}
    for s in sorted(different, key=owner.get):
        todo = [s] if s not in root else []
        while todo:
            if (t := todo.pop()) not in root:
                root[t] = owner[s]
                todo += links[t]
    return sorted((i, len(s), root[s] if s else i) for i, s in sets)


def joined(docs, **options):
    return sorted(tuple(r) for r in ngram_join.near_duplicates(docs, **options).collect())


def varied(seed, n=160):
    """Chains of near copies of a few texts, some long, from few words; and unrelated ones."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [[pick.choice(words) for _ in range(pick.choice([4, 20, 60, 400, 2200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(pick.choice(texts)) if i % 4 else [pick.choice(words) for _ in range(60)]
        for _ in range(pick.choice([0, 1, 2, len(text) // 50])):
            text[pick.randrange(len(text))] = pick.choice(words)
        if i % 3 == 0:
            texts[pick.randrange(len(texts))] = text
        rows.append((i * 7 % n, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, options", [
    (1, {"words": 3, "percent": 90}),
    (2, {"words": 5, "percent": 80}),
    (3, {"words": 3, "percent": 90, "reach": 2, "block_groups": 7, "block_members": 6}),
    (4, {"words": 2, "percent": 60, "reach": 1, "block_members": 3}),
    (5, {"words": 3, "percent": 90, "block_elements": 900, "block_groups": 5, "reach": 3}),
])
def test_join_equals_brute_force(spark, seed, options):
    rows = varied(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(docs, **options) == brute(rows, options["words"], options["percent"])


def test_join_of_repeated_ids_with_other_texts(spark):
    """Two texts of one id, each with a near copy under another id; and one id with both."""
    pick = random.Random(9)
    rows = []
    for i in range(40):
        a, b = ([f"w{pick.randrange(500)}" for _ in range(60)] for _ in range(2))
        near = lambda x: [*x[:30], "other", *x[30:]]
        rows += [(4 * i, " ".join(a)), (4 * i, " ".join(b)), (4 * i + 1, " ".join(near(a))), (4 * i + 2, " ".join(near(b))), (4 * i + 3, " ".join(near(near(b)))), (4 * i + 3, f"alone {i} x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(docs) == brute(rows, 3, 90)
    left = sorted(tuple(r) for r in ngram_join.one_of_each(docs).collect())
    assert left == sorted(r for r in rows if r[0] % 4 == 0 or r[1].startswith("alone"))


@pytest.mark.parametrize("block_members", [500, 20])
def test_join_of_one_large_cluster(spark, block_members):
    """Many near copies of one text, which make one component, and some that hang on by others only."""
    pick = random.Random(4)
    text = [f"w{pick.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(text)) for i in range(300, 310)]
    for i in range(260):
        copy = list(text)
        for _ in range(pick.choice([1, 1, 1, 2, 3, 4])):
            copy[pick.randrange(len(copy))] = f"x{pick.randrange(50)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(docs, block_members=block_members) == brute(rows, 3, 90)


def test_join_of_driver_rows(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs) == brute(rows, 3, 90)


def test_join_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in AWKWARD], "doc_id long, text string, print string, n int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(0, 2, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 1, 9), (9, 2, 9), (9, 2, 9), (10, 4, 10)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 1
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("last", [10_000, 3, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(connected, "LAST_EDGES", last)
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 55), (70, 70), (60, 50)]
    got = {r.node: r.root for r in connected.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 55: 50, 60: 50}
    assert connected.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_differ_in_more_bits_than_sets(spark):
    pick = random.Random(5)
    for _ in range(50):
        a, b = (ngram_join.np.unique(ngram_join.np.array([pick.randrange(3000) for _ in range(pick.randrange(1, 900))], "uint64") * ngram_join._BASE) for _ in range(2))
        bits = int(ngram_join.np.bitwise_count((ngram_join.sketch(a, 512) ^ ngram_join.sketch(b, 512)).view("uint64")).sum())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def plain_mix(rows):
    """Copies of each row (doc_id, text, source): shares by weight, cut at twice the source and shared again, then floor and one draw."""
    sizes = {}
    size = lambda text: len(re.findall(mixing.TOKEN, text or ""))
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    left, targets = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}, {}
    while left:
        level = (1.5 * sum(sizes.values()) - sum(targets.values())) / sum(left.values())
        over = [s for s, w in left.items() if w * level > 2 * sizes[s]]
        for s in over or list(left):
            targets[s] = 2.0 * sizes[s] if over else left[s] * level
            del left[s]
    out = {}
    for i, _, source in rows:
        rate = round(targets[source], 6) / sizes[source] if sizes[source] else 0
        draw = int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[i] = int(rate) + (draw < rate - int(rate))
    return out


def plain_stages(rows):
    """The pipeline by plain versions: rows (doc_id, text, source) after each stage."""
    import sentencepiece

    letter = lambda text: any(c.isalpha() for c in text or "")
    one = [r for r in rows if letter(r[1])]
    yield one
    cut = plain_line_dedup([(i, text) for i, text, _ in one])
    two = [(i, cut[i], source) for i, text, source in one if cut[i] == text or cut[i].strip()]
    yield two
    keep = {i for i, _, root in brute([r[:2] for r in two], 5, 80) if i == root}
    three = [r for r in two if r[0] in keep]
    yield three
    copies = plain_mix(three)
    four = [r for r in three for _ in range(copies[r[0]])]
    yield four
    with open(PIECES_MODEL, "rb") as file:
        library = sentencepiece.SentencePieceProcessor(model_proto=pieces.unigram(file.read()))
    yield [(*r, tuple(library.encode(r[1]))) for r in four]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage of the driver's documents and awkward rows, with columns of clashing names, which keep their values."""
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).where("text IS NULL OR length(text) < 20000")
    extra = [(90001, None, None, "web", 0), (90002, "123 ... 456", "en", None, 11), (90003, "", "en", "web", 0), (90004, "a null source", "en", None, 13)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    clash = {c: F.lit(f"own {c}") for c in ("lang_pred", "lang_score", "score", "__lang", "__score", "dropped_lines", "dropped", "__dropped", "__id", "id", "_id", "gone", "__gone", "component_id", "mark", "__mark", "copies", "size", "row")}
    docs = docs.withColumns(clash)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = plain_stages([(r.doc_id, r.text, r.source) for r in kept.collect()])
    for at, ((name, stage), rows) in enumerate(zip(corpus_pipeline.STAGES, want, strict=True)):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"stage{at}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{at}"))
        got = [(r.doc_id, r.text, r.source, *([tuple(r.ids)] if at == 4 else [])) for r in kept.collect()]
        assert sorted(got, key=str) == sorted(rows, key=str), name
        assert kept.columns == docs.columns + ["ids", "n_ids"] * (at == 4)
        assert all(kept.where(F.col(c) != f"own {c}").isEmpty() for c in clash)
        assert kept.where("n_chars <> length(text) AND n_chars = 0").isEmpty()
    assert kept.where(F.size("ids") != F.col("n_ids")).isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).exceptAll(kept).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
