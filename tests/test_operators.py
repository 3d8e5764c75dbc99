"""Readers, writers, entities and learning on tiny inputs; queries against DuckDB on the driver's smallest tables."""

import gzip
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import entities, gold, learning, retrieval, scoring, vectors
from millrace.plans import experiment
from millrace.plans.queries import ORACLE_SQL, QUERIES
from millrace.sources import readers, sinks, tables
from millrace.streaming import ingest
from tests.conftest import DATA

QUADS = """_:a1 <http://schema.org/Product/name> "Red Steel Kettle"@en <http://shop.example.com/p/1> .
_:a1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://schema.org/Product> <http://shop.example.com/p/1> .
_:a1 <http://schema.org/Product/name> "Kettle 1.7L" <http://shop.example.com/p/1> .
_:a1 <http://schema.org/Product/color> "dark red "q"" <http://shop.example.com/p/1> .
_:a2 <http://schema.org/Offer/name> "Wasserkocher"@de <http://laden.example.de/p/9> .
too short line
"""


def test_quads_to_products(spark, tmp_path):
    with gzip.open(tmp_path / "q.gz", "wt") as file:
        file.write(QUADS)
    lines = readers.quad_lines(spark, str(tmp_path))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3, 4, 5, 6]
    assert readers.line_range(lines, 2, 4).count() == 2 and readers.count_lines(spark, str(tmp_path)).first()["count"] == 6
    quads = entities.with_fields(entities.parse_quads(lines))
    assert quads.count() == 5
    kept = entities.english_entities(entities.assemble(quads))
    row = kept.first()
    assert kept.count() == 1 and row.id == "_:a1|http://shop.example.com/p/1"
    assert row.fields == {"product_name": "Kettle 1.7L Red Steel Kettle", "rdfs_type": "http://schema.org/Product", "http://schema.org/Product/color_t": 'dark red "q"'}
    record = entities.product_records(entities.select_products(entities.wide(kept)), "x").first()
    assert (record.name, record.host, record.category, record.source_entity_index) == ("Kettle 1.7L Red Steel Kettle", "shop.example.com", "", "x")
    numbered = entities.runs(quads, "id", ["line_no"], ["file"])
    assert [r.run for r in numbered.orderBy("line_no").collect()] == [1, 1, 1, 1, 2]


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, name in enumerate(("Old Kettle", "New Kettle")):
        (tmp_path / "in" / f"{n}.txt").write_text(f'_:a <http://schema.org/Product/name> "{name}"@en <http://x.com/1> .\n')
        ingest.ingest_quads(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert ingest.latest(spark, str(tmp_path / "out")).first().fields == {"product_name": "New Kettle"}


def test_readers(spark, tmp_path):
    (tmp_path / "offers.json").write_text('{"cluster_id":1,"url":"u","categoryLabel":"c","schema.org_properties":[{"/name":"[a]"},{"/name":"[b]"}],"parent_schema.org_properties":[{"/brand":"[x]"}]}\n{"cluster_id":2,"url":"u","categoryLabel":"c","schema.org_properties":[],"parent_schema.org_properties":[{"/title":"[t]"}]}\n')
    rows = readers.cluster_offers(readers.json_lines(spark, str(tmp_path / "offers.json"), readers.LABELLED)).orderBy("ID").collect()
    assert [(r.Name, r.Brand) for r in rows] == [("b", "x"), ("t", "")]
    assert readers.settings('a=1\n# b=2\nc="x=y"', {"a": "3"}) == {"a": "3", "c": "x=y"}
    pairs = spark.createDataFrame([(1, "a", "b", "c")], "label int, left_x string, left_y string, right_x string")
    assert tuple(readers.pair_sides(pairs).first()) == (1, "a b", "c")
    assert [r.name for r in readers.tasks(spark.createDataFrame([("a -",), ("a",), ("",)], "name string")).collect()] == ["a"]
    (tmp_path / "v.txt").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    assert {r.word: r.vector for r in readers.embeddings(spark, str(tmp_path / "v.txt")).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    (tmp_path / "f.txt").write_text("7 the\n3 of\n")
    assert readers.frequencies(spark, str(tmp_path / "f.txt")).agg(F.sum("freq")).first()[0] == 10


def test_sinks(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("a b c").alias("text"))
    shards = sinks.shards_by_words(rows, "text", "id", 9)
    assert {r.id: r.shard for r in shards.collect()} == {i: i // 3 for i in range(10)}
    sinks.write_shards(shards, "text", str(tmp_path / "s"))
    sinks.rolling_csv(rows, str(tmp_path / "c"), 2)
    assert spark.read.csv(str(tmp_path / "c")).count() == 10
    assert {r.id: r.batch for r in sinks.in_batches(rows, ["id"], 4).collect()}[9] == 2
    changes = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b"), ("k", 3, "c", None)], "id string, seq int, x string, y string")
    assert tuple(sinks.upsert(changes, "id", ["seq"]).first()) == ("k", "c", "b")


def test_bm25_grows_with_frequency(spark):
    docs = spark.createDataFrame([(1, "kettle red red"), (2, "kettle kettle red"), (3, "table blue wood")], "id int, text string")
    hits = retrieval.bm25(spark.createDataFrame([(1, "kettle")], "q int, text string"), retrieval.postings(docs, "id"), "q", "id").orderBy("rank").collect()
    assert [r.id for r in hits] == [2, 1]
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert hits[1].score == pytest.approx(idf * 1 * 2.2 / (1 + 1.2), abs=1e-6)


def test_scores_and_splits(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "pred string, truth string")
    got = {r.line: r for r in scoring.report(rows).collect()}
    assert got["accuracy"].p == 0.5 and got["b"].r == pytest.approx(1 / 3, abs=1e-6) and got["c"].support == 0
    labelled = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("label"))
    folded = gold.folds(labelled, "label", "id", 5).groupBy("label", "fold").count().collect()
    assert max(r["count"] for r in folded) - min(r["count"] for r in folded) <= 1
    train, test = gold.split_by_clusters(labelled, labelled.where("id < 10").select("id"), "id")
    assert (train.count(), test.count()) == (90, 10) and train.join(test, "id").count() == 0


def test_vectors(spark):
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "zzz")], "id int, word string")
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<float>")
    assert {r.id: r.vector for r in vectors.embed_text(words, table, "id").collect()} == {1: [4, 6], 2: [1, 2]}
    assert {r.id: r.vector for r in vectors.embed_text(words, table, "id", "mean").collect()}[1] == [2, 3]
    with pytest.raises(ValueError):
        vectors.nearest(table, table.withColumnRenamed("word", "t"), "word", "t", most_bytes=8)


def test_experiment(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("red kettle steel" if i % 2 else "oak table wood") + f" n{i}", "kitchen" if i % 2 else "furniture") for i in range(40)], "id long, Name string, lvl1 string")
    settings = {"class_fieldname": "lvl1", "text_fieldnames": "Name,20", "algorithm": "lr", "n_fold": "2", "key": "id"}
    got = {r.line: r for r in experiment.run(settings, rows.where("id < 30"), rows.where("id >= 30")).collect()}
    assert got["accuracy"].p == 1
    model = learning.fit(learning.word_columns(rows, [("Name", None)]), "nb", "lvl1", learning.hashed())
    model.write().overwrite().save(str(tmp_path / "m"))
    assert learning.predict(str(tmp_path / "m"), learning.word_columns(rows, [("Name", None)])).where("pred <> lvl1").count() == 0


def test_unseen_classes_count(spark):
    """Rows of a class that training lacks are wrong, not left out; rows without a class teach nothing; the bound on classes is an error."""
    rows = spark.createDataFrame([(i, ("red kettle", "oak table", "silk scarf")[i % 3], ("kitchen", "furniture", "fashion")[i % 3] if i < 58 else None) for i in range(60)], "id long, Name string, lvl1 string")
    train, test = rows.where("lvl1 IS NULL OR lvl1 <> 'fashion'"), rows.where("id < 30")
    words = lambda df: learning.word_columns(df, [("Name", None)])
    for name in ("lr", "nb", "svm", "rf"):
        # a forest looks at the square root of all features at each node: few features, so that each tree sees one that tells
        stages = learning.hashed(size=16 if name == "rf" else 1 << 14)
        got = {r.line: r for r in learning.holdout_scores(words(train), words(test), name, "lvl1", stages).collect()}
        assert got["accuracy"].p == pytest.approx(2 / 3, abs=1e-6) and got["accuracy"].support == 30, name
        assert (got["fashion"].r, got["fashion"].support) == (0, 10)
    with pytest.raises(ValueError):
        learning.fit(words(rows), "lr", "lvl1", learning.hashed(), most_labels=2)
    alone = learning.fit(words(rows.where("lvl1 = 'fashion'")), "nb", "lvl1", learning.hashed()).transform(words(test))
    assert {r.pred for r in alone.collect()} == {"fashion"}


def test_experiment_of_sub_words_and_levels(spark):
    rows = spark.createDataFrame([(i, f"{'kettles' if i % 2 else 'tables'} {i}x", "kitchen" if i % 2 else "furniture", "a" if i % 4 else "b") for i in range(40)], "id long, Name string, lvl1 string, lvl2 string")
    settings = {"class_fieldname": "lvl1", "text_fieldnames": "Name", "algorithm": "fasttext", "n_fold": "2", "key": "id"}
    test = spark.createDataFrame([(1, "kettle", "kitchen", "a"), (2, "stable", "furniture", "b")], rows.schema)
    got = {(r.level, r.line): r for r in experiment.run_levels(settings, ["lvl1", "lvl2"], rows, test).collect()}
    assert got["lvl1", "accuracy"].p == 1 and got["lvl2", "accuracy"].support == 2
    terms = rows.limit(1).select(learning.subword_terms(F.split(F.lit("ab cd"), " "), 3, 4, 2).alias("t")).first().t
    assert terms == ["ab", "cd", "ab cd", "<ab", "ab>", "<ab>", "<cd", "cd>", "<cd>"]


def test_places(spark):
    """Numbers along an order, whole and within labels, one of which has most rows, with nulls and equals."""
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "b" if i % 11 == 0 else "a", i * 7 % 400) for i in range(400)], "id long, label string, at long").repartition(5)
    assert {r.at: r.place for r in tables.placed(rows, ["at"]).collect()} == {i: i for i in range(400)}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: -r.at):
        want.setdefault(r.label, []).append(r.id)
    got = {(r.label, r.nth): r.id for r in tables.placed(rows, [F.desc("at")], ["label"], "nth").collect()}
    assert got == {(k, n): i for k, ids in want.items() for n, i in enumerate(ids)}
    assert tables.placed(rows.limit(0), ["at"]).count() == 0
    assert {(r.label, r.n) for r in tables.sized(rows, "label", "n").collect()} == {(k, len(ids)) for k, ids in want.items()}


def test_quad_lines_of_every_form(spark):
    lines = ['<a> <p> "x "y" z"@en <http://h/1> .', '<a> <p> "no tag" http://h/2 .', "<a> <p> <o> <http://h/3> .", '_:b <p> "\x01 odd" <http://h/4> <more> .', "<a> <p> <o>", '<a> <p> "open', '<a> <p> "t"^^<int> <http://h/5>']
    frame = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no long, value string")
    got = [(r.s, r.p, r.o, r.tag, r.source, r.literal) for r in entities.parse_quads(frame).orderBy("line_no").collect()]
    assert got == [
        ("a", "p", 'x "y" z', "@en", "http://h/1", True),
        ("a", "p", "no tag", "", "http://h/2", True),
        ("a", "p", "o", "", "http://h/3", False),
        ("_:b", "p", "\x01 odd", "", "http://h/4", True),
        ("a", "p", "t", "^^<int>", "http://h/5", True),
    ]


def test_compact_and_corpus_words(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "p"))
    sinks.compact(spark, str(tmp_path / "p"), str(tmp_path / "one"))
    sinks.compact(spark, str(tmp_path / "p"), str(tmp_path / "more"), 3000)
    files = lambda name: len(list((tmp_path / name).glob("*.parquet")))
    assert files("one") == 1 and files("more") > 2 and spark.read.parquet(str(tmp_path / "more")).count() == 1000
    (tmp_path / "t.txt").write_text("The Red  kettle\n\n and more\n")
    assert [(r.line_no, r.words) for r in readers.corpus_words(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == [(1, ["the", "red", "kettle"]), (3, ["and", "more"])]
    sentences = readers.corpus_words(spark, str(tmp_path / "t.txt"))
    assert {r.word for r in learning.word_vectors(sentences, size=4, least=1).collect()} == {"the", "red", "kettle", "and", "more"}


def test_hits_beyond_copies_and_short_texts(spark, tmp_path):
    """30 copies, 30 texts like the item itself and 30 short texts are no reason to miss what ranks after them."""
    item = "red kettle"
    copies, others = "red kettle red kettle of steel", [f"red kettle number{i} " + "word " * 60 for i in range(12)]
    texts = [copies] * 30 + ["Red  Kettle"] * 30 + ["red kettle red kettle"] * 30 + others
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["desc_expander"](spark, str(tmp_path)).first()
    assert got.hits == 5
    at = {(r.prefix, r["at"]): r.doc_id for r in QUERIES["nested_prefix_corpus"](spark, str(tmp_path)).collect()}
    assert at == {(p, i + 1): 90 + i for p in (1, 5, 10) for i in range(p)}


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 5) if isinstance(value, int | float) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_duckdb(spark, name):
    sf = DATA / "sf0.001"
    frame = QUERIES[name](spark, str(sf))
    columns = sorted(frame.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    db = duckdb.connect()
    for path in sf.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = db.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    want = [tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
