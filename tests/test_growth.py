"""Steps that must stay in place as tables grow, against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus, languages, retrieval, vectors

LETTERS = ["a", "B", "é", "ß", "中", "𐐀", " ", "1", "\n", "!", "'"]


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_triples_are_counted_in_place(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["", "é", None, "ab", "𐐀𐐀𐐀", *("".join(rng.choices(LETTERS, k=rng.randrange(90))) for _ in range(60))]
    docs = spark.createDataFrame([(i, ["en", "de"][i % 2], t) for i, t in enumerate(texts)], "id int, lang string, text string")
    even = {r.id: r.e for r in docs.select("id", languages.even(F.col("text")).alias("e")).collect()}
    plain = {i: [(ord(a) * 961 + ord(b) * 31 + ord(c)) % languages.BUCKETS for a, b, c in zip(e, e[1:], e[2:])] for i, e in even.items()}
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(languages, "SLICE", size)
        got = []
        for row, begins, buckets in languages._triples(pa.array([even[i] for i in range(len(texts))])):
            assert row == len(got)
            got += [[b for b in part.tolist() if b < languages.BUCKETS] for part in (buckets[x:y] for x, y in zip(begins, [*begins[1:], len(buckets)]))]
        assert got == [plain[i] for i in range(len(texts))]
    known = languages.profiles(docs)
    said = docs.select("id", languages.language(F.col("text"), known).alias("l"))
    want = {i: min(known, key=lambda n: (-sum(known[n][b] for b in plain[i]), n)) if any(c.isalpha() for c in t or "") else None for i, t in enumerate(texts)}
    assert {r.id: r.l for r in said.collect()} == want
    assert "lambdafunction" not in explained(said)  # no sum over letters by an interpreted lambda


@pytest.mark.parametrize("weighed", [False, True])
def test_rows_meet_targets_in_place(spark, weighed):
    rng = random.Random(9)
    words = ["a", "b", "c", "d", "é", "zz", ""]
    rows = spark.createDataFrame([(i, None if i == 3 else [*rng.choices(words, k=rng.randrange(9)), *[None] * (i % 2)]) for i in range(80)], "id int, words array<string>")
    targets = spark.createDataFrame([(f"t{i % 7}", w, float(1 + i % 3)) for i, w in enumerate(words[:5] * 3)], "target string, word string, weight double").distinct().groupBy("target", "word").agg(F.max("weight").alias("weight"))
    factors = spark.createDataFrame([("a", 0.5), ("b", 2.0), ("zz", 3.0), ("é", 1.0)], "word string, factor double") if weighed else None
    near = lambda rows, **how: vectors.nearest_of_rows(rows, "id", F.col("words"), targets, "target", factors, **how)
    got = near(rows)
    assert "Exchange" not in explained(got)
    assert sorted(got.collect()) == sorted(near(rows, most=1).collect()) and got.count() > 40
    twice = rows.unionByName(rows.where("id = 5"))
    assert sorted(near(twice).collect()) == sorted(near(twice, most=1).collect())
    assert near(rows.limit(0)).count() == 0


def test_candidates_hold_the_best(spark):
    """The first hits by candidates, of which batches send few, equal those by all pairs, with and without what is left out."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["kettle", "lid", "steel", "Handle", "spout", "tea", "é"], k=rng.randrange(8))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t if i % 9 else None) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:9], "", "nowhere"])], "q int, text string")
    pairs = retrieval.bm25_scores(asked, retrieval.postings(docs, "id"), "q", "id")
    rows = lambda hits: sorted(map(tuple, retrieval.best(hits.select("q", "id", "score"), "q", "id", 3).collect()))
    found = retrieval.bm25_candidates(asked, docs, "q", "id", k=3)
    assert rows(found) == rows(pairs) and found.count() < pairs.count() / 4
    fine = F.col("id") % 2 == 0
    assert rows(retrieval.bm25_candidates(asked, docs, "q", "id", k=3, fine=fine)) == rows(pairs.where(fine))
    texts_of = docs.select("id", "text").join(pairs, "id").join(asked.select("q", F.col("text").alias("own")), "q").where("text <> own")
    once = lambda hits: hits.groupBy("q", "copy").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("hit")).select("q", "hit.*")
    part = retrieval.bm25_candidates(asked, docs, "q", "id", k=3, copy=F.md5("text"), itself=(F.col("text"), F.col("text")))
    assert rows(once(part)) == rows(once(texts_of.withColumn("copy", F.md5("text"))))
    assert retrieval.bm25_candidates(asked, docs, "q", "id", most=3) is None
    assert retrieval.bm25_candidates(asked, docs.unionByName(docs), "q", "id") is None
    assert retrieval.bm25_candidates(asked.limit(0), docs, "q", "id").count() == 0 == retrieval.bm25_candidates(asked, docs.limit(0), "q", "id").count()


def test_words_are_counted_in_place(spark):
    rng = random.Random(4)
    texts = [None if i == 4 else " ".join(rng.choices(["Kettle", "lid,", "http://x.y/z", "--", "tea", "é"], k=rng.randrange(12))) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    twice = docs.unionByName(docs)  # keys that repeat are counted together, by a shuffle
    want = corpus.word_rows(docs, T.normal_words(F.col("text")), "id").groupBy("id", "word").agg(F.count("*").alias("n"))
    assert sorted(corpus.word_counts(docs, "id").collect()) == sorted(want.collect())
    assert sorted(corpus.word_counts(twice, "id").collect()) == sorted((r.id, r.word, 2 * r.n) for r in want.collect())
    known = spark.createDataFrame([("tea",), ("lid",), ("tea",)], "word string")
    small, large = (corpus.instance_stats(docs, "id", known, most=most) for most in (9, 1))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert "word" not in "".join(line for line in explained(small).splitlines() if "Exchange hashpartitioning" in line)  # words go nowhere
