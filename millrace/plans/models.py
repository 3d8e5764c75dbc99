"""Queries of neighbours, clusters, languages, discriminative learners and stored entities, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import text as T
from millrace.operators import clustering, corpus, discriminative, embedding, entities, forests, languages, layouts, learning, neighbours, retrieval, vectors
from millrace.plans.queries import _NAMES, _name_hits, _query, table
from millrace.sources import binary_vectors, readers, sinks
from millrace.sources.tables import new_folder, placed, written

# --- neighbours and clusters -----------------------------------------------------------------------------------------


@_query("""WITH q AS (SELECT vec_id AS a, label AS truth, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 3 = 0), t AS (SELECT vec_id AS b, label AS pred, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id % 3 <> 0),
        d AS (SELECT a, truth, b, pred, list_distance(x, y) AS d FROM q, t) SELECT a AS vec_id, truth, pred, b AS nearest, round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1""")
def nearest_neighbour_labels(spark, sf):
    rows = table(spark, sf, "embeddings")
    known = rows.where("vec_id % 3 <> 0")
    found = neighbours.nearest(rows.where("vec_id % 3 = 0"), known, "vec_id", "vec_id", "embedding")
    found = found.join(rows.select("vec_id", F.col("label").alias("truth")), "vec_id").join(known.select(F.col("vec_id").alias("nearest"), F.col("label").alias("pred")), "nearest")
    return found.select("vec_id", "truth", "pred", "nearest", F.round("distance", 5).alias("distance"))


@_query("""WITH e AS (SELECT vec_id AS a, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT p.a, q.a AS b, list_distance(p.x, q.x) AS d FROM e p, e q WHERE p.a <> q.a)
        SELECT a AS vec_id, b AS nearest, round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1""")
def nearest_other_vector(spark, sf):
    rows = table(spark, sf, "embeddings")
    return neighbours.nearest(rows, rows, "vec_id", "vec_id", "embedding", skip_own=True).withColumn("distance", F.round("distance", 5))


def _tree(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return rows, clustering.ward(rows, "vec_id", "embedding")


@_query()
def ward_clusters(spark, sf):
    """Vectors with their cluster when the dendrogram is cut at ten; a plain Ward agrees in the tests."""
    rows, tree = _tree(spark, sf)
    return clustering.cut(rows, tree, "vec_id", 10).select("vec_id", "label", "cluster")


@_query()
def ward_scores(spark, sf):
    """The Calinski-Harabasz score of the dendrogram's cuts, and whether it is the best."""
    rows, tree = _tree(spark, sf)
    found = written(clustering.scores(rows, tree, "vec_id", "embedding", [2, 4, 8, 16, 32]), "scores")  # read twice
    best = found.agg(F.max("score").alias("best"))
    return found.crossJoin(best).select("k", "clusters", "rows", "score", (F.col("score") == F.col("best")).alias("is_best"))


# --- languages -------------------------------------------------------------------------------------------------------


@_query(r"""WITH t AS (SELECT doc_id, lang, text, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents),
        g AS (SELECT doc_id, lang, text, (unicode(c[i]) * 961 + unicode(c[i + 1]) * 31 + unicode(c[i + 2])) % 4096 AS b FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM t)),
        n AS (SELECT lang, b, count(*) AS n FROM g WHERE doc_id % 3 <> 1 AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL), s AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
        w AS (SELECT s.lang, r.b, floor(1000 * ln((coalesce(n, 0) + 0.5) / (total + 2048)) + 0.5)::BIGINT AS w FROM s CROSS JOIN (SELECT unnest(range(4096)) AS b) r LEFT JOIN n ON n.lang = s.lang AND n.b = r.b),
        f AS (SELECT doc_id, w.lang AS pred, sum(w) AS fit FROM g JOIN w USING (b) WHERE regexp_matches(text, '\p{L}') GROUP BY ALL), best AS (SELECT doc_id, arg_min(pred, {'f': -fit, 'l': pred}) AS pred FROM f GROUP BY doc_id)
        SELECT d.doc_id, d.lang AS truth, pred FROM documents d LEFT JOIN best USING (doc_id)""")
def language_of_texts(spark, sf):
    docs = table(spark, sf, "documents")
    known = languages.profiles(docs.where("doc_id % 3 <> 1"))
    return docs.select("doc_id", F.col("lang").alias("truth"), languages.language(F.col("text"), known).alias("pred"))


@_query()
def english_descriptions(spark, sf):
    """Product records of documents' texts as descriptions: those that a fitted profile takes for English stay."""
    docs = table(spark, sf, "documents")
    known = languages.profiles(docs)
    empty = F.lit(None).cast(StringType())
    wide = docs.select(
        F.concat(F.lit("d|http://shop.example.com/"), "doc_id").alias("id"),
        F.concat(F.lit("Document number "), "doc_id").alias("product_name"),
        empty.alias("offer_name"),
        F.col("text").alias("product_description"),
        empty.alias("offer_description"),
        F.col("source").alias("product_category"),
        empty.alias("offer_category"),
        F.lit("http://shop.example.com/x").alias("source_page"),
        F.lit("shop.example.com").alias("source_host"),
    )
    return entities.product_records(wide, is_english=lambda c: languages.spoken(c, known)).select("id", "name", "category", "desc")


# --- learners --------------------------------------------------------------------------------------------------------


def _halves(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("truth"), "embedding")
    return rows, rows.where("vec_id % 3 <> 0")


@_query()
def squared_hinge_labels(spark, sf):
    """Classes of held-out vectors by squared-hinge machines, one against the rest."""
    rows, train = _halves(spark, sf)
    classes, w = discriminative.squared_hinge(train, "truth", "embedding")
    return discriminative.decided(rows.where("vec_id % 3 = 0"), "embedding", classes, w).select("vec_id", "truth", "pred")


@_query()
def rbf_labels(spark, sf):
    """Classes of held-out vectors by the same machines on RBF features of 100 landmarks, with what the features miss."""
    rows, train = _halves(spark, sf)
    make, missed = discriminative.rbf_features(train, "embedding")
    seen = discriminative.mapped(rows, "embedding", "seen", make)
    classes, w = discriminative.squared_hinge(seen.where("vec_id % 3 <> 0"), "truth", "seen", c=1.0)
    return discriminative.decided(seen.where("vec_id % 3 = 0"), "seen", classes, w).select("vec_id", "truth", "pred", F.lit(round(missed, 6)).alias("missed"))


@_query()
def discriminant_vectors(spark, sf):
    """All vectors in the directions that part their classes, and the class of the nearest known vector there."""
    rows, train = _halves(spark, sf)
    directions = discriminative.discriminants(train, "truth", "embedding")
    seen = discriminative.projected(rows, "embedding", directions, "seen")
    found = neighbours.nearest_label(seen.where("vec_id % 3 = 0"), seen.where("vec_id % 3 <> 0"), "vec_id", "truth", "seen")
    return seen.join(found, "vec_id", "left").select("vec_id", "truth", "pred", F.transform("seen", lambda x: F.round(x, 5)).alias("seen"))


# --- stored entities -------------------------------------------------------------------------------------------------


@_query("""SELECT user_id, arg_max(value, {'ts': ts, 'event_id': event_id}) FILTER (value IS NOT NULL) AS value, arg_max(event_type, {'ts': ts, 'event_id': event_id}) FILTER (event_type IS NOT NULL AND event_id % 4 <> 1) AS event_type FROM events GROUP BY user_id""")
def incremental_upsert(spark, sf):
    """Events come in three batches out of order, some without a kind; the stored table then has each field's latest value."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", F.when(F.col("event_id") % 4 != 1, F.col("event_type")).alias("event_type"))
    path = new_folder(spark, "entities")
    for batch in (2, 0, 1):
        sinks.merge_entities(events.where(F.col("event_id") % 3 == batch), path, "user_id", ["ts", "event_id"])
    return sinks.stored_entities(spark, path, "user_id")


# --- candidates by retrieval -----------------------------------------------------------------------------------------


@_query(f"""WITH {_NAMES}, c AS (SELECT p_name, min(p_type) AS category FROM part GROUP BY 1), s AS (SELECT query, hit, round(jaccard(lower(query), lower(hit)), 6) AS similarity, rank, q.category = h.category AS same FROM rk JOIN c q ON q.p_name = query JOIN c h ON h.p_name = hit WHERE lower(query) <> lower(hit)),
        a AS (SELECT 'cat_' || query AS ref_name, query, hit, similarity FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 50),
        b AS (SELECT query AS ref_name, query, hit, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 50), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
        SELECT ref_name, hit, similarity, row_number() OVER (PARTITION BY ref_name ORDER BY similarity DESC, hit) AS rank FROM u WHERE similarity BETWEEN 0.3 AND 0.95 QUALIFY rank <= 10""")
def annotation_candidates(spark, sf):
    """Two retrievals per name, among names of its category and among all, and the band of similar names of both."""
    kinds = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_type").alias("category"))
    found = _name_hits(spark, sf, 1 << 30).where(retrieval.not_itself(F.col("name"), F.col("hit_name")))
    found = found.join(kinds.select(F.col("p_name").alias("name"), F.col("category").alias("own")), "name").join(kinds.select(F.col("p_name").alias("hit_name"), "category"), "hit_name")
    band = lambda hits: retrieval.similar_band(retrieval.first_hits(hits, "query", 50), "query", "name", "hit_name", low=0.3).withColumnRenamed("name", "ref_name")
    out = retrieval.annotation_rows(band(found.where("own = category")), band(found))
    return out.select("ref_name", F.col("hit_name").alias("hit"), "similarity", "rank")


@_query(f"""WITH {_NAMES} SELECT c.p_brand AS cluster, list_sort(list(DISTINCT p.p_type)) AS categories FROM (SELECT DISTINCT p_brand, p_name FROM part) c JOIN rk ON rk.query = c.p_name AND rk.rank <= 10 JOIN part p ON p.p_name = rk.hit WHERE jaccard(lower(rk.query), lower(rk.hit)) > 0.9 GROUP BY 1""")
def categories_of_cluster_titles(spark, sf):
    """Each title of a cluster is looked up; categories of the products found that are all but equal to it."""
    part = table(spark, sf, "part")
    titles = part.select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("query")).distinct()
    hits = titles.join(_name_hits(spark, sf, 10), "query").join(part.select(F.col("p_name").alias("hit_name"), F.col("p_type").alias("category")), "hit_name")
    return retrieval.cluster_categories(hits, "cluster", "name", "hit_name", "category")


# --- literals --------------------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, md5(replace(replace(text, chr(233), chr(228)), chr(10), chr(9))) AS digest, text LIKE '%' || chr(228) || '%' OR text LIKE '%' || chr(233) || '%' AS accented FROM documents""")
def escaped_literals(spark, sf):
    r"""Texts whose line ends and letters were written as escapes (\t, ä, \") are read back; the SQL never sees an escape."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), "\n", r"\\t"), "[éä]", r"\\u00E4"), '"', r'\\"')
    docs = table(spark, sf, "documents").select("doc_id", T.unescape(text).alias("text"))
    return docs.select("doc_id", F.md5("text").alias("digest"), F.col("text").rlike("[éä]").alias("accented"))


# --- embeddings ------------------------------------------------------------------------------------------------------


@_query()
def cbow_neighbours(spark, sf):
    """Word vectors of the benchmark's and conversations' texts, and the word nearest to each."""
    texts = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text").unionByName(table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"))
    rows = texts.select("id", T.letters_only(F.coalesce("text", F.lit(""))).alias("words"))
    found = embedding.cbow(rows, "id", dims=32, passes=3)
    unit = found.select("word", F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))).alias("vector"))
    return neighbours.nearest(unit, unit, "word", "word", skip_own=True).select("word", "nearest", F.round("distance", 4).alias("distance"))


@_query()
def shared_heads(spark, sf):
    """Type and brand of held-out parts by two classifiers on the same hashed words and sub-words."""
    part = table(spark, sf, "part")
    words = T.letters_only(F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "0123456789", "abcdefghij")))
    rows = part.select("p_partkey", "p_type", "p_brand", learning.subword_terms(words, low=3, high=5, grams=2).alias("terms"))
    model = embedding.fit_shared(rows.where("p_partkey % 3 <> 0"), "p_partkey", "terms", ["p_type", "p_brand"], size=1 << 14, dims=16, passes=10, rate=1.0, parts=2)
    return embedding.predict_shared(rows.where("p_partkey % 3 = 0"), "terms", model).drop("terms")


# --- vocabularies and layouts ----------------------------------------------------------------------------------------

_OOV = "v AS (SELECT word, min(p_partkey) AS index FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part) GROUP BY word), m AS (SELECT word, [length(word), ord(word) % 7]::DOUBLE[] AS vector FROM (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type) || ' ' || p_brand, ' ')) AS word FROM part))"


def _vocabulary(spark, sf):
    part = table(spark, sf, "part")
    words = part.select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word")).groupBy("word").agg(F.min("p_partkey").alias("index"))
    model = part.select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand"), " ")).alias("word")).distinct()
    return words, model.select("word", F.array(F.length("word").cast("double"), (F.ascii("word") % 7).cast("double")).alias("vector"))


@_query(f"""WITH {_OOV}, o AS (SELECT *, row_number() OVER (ORDER BY md5(word), word) AS nth FROM v WHERE word NOT IN (SELECT word FROM m)), f AS (SELECT vector, row_number() OVER (ORDER BY md5(word), word) AS nth FROM m WHERE word NOT IN (SELECT word FROM v)),
        u AS (SELECT 0 AS strategy, word, index, coalesce(vector, [0, 0]::DOUBLE[]) AS x FROM v LEFT JOIN m USING (word)
              UNION ALL SELECT 1, word, index, coalesce(vector, list_transform([1, 2], lambda i: ('0x' || left(md5(word || '|' || i), 8))::BIGINT / 4294967296.0)) FROM v LEFT JOIN m USING (word)
              UNION ALL SELECT 2, word, index, vector FROM v JOIN m USING (word) UNION ALL SELECT 2, word, index, coalesce(vector, [0, 0]::DOUBLE[]) FROM o LEFT JOIN f USING (nth))
        SELECT strategy, word, index, round(x[1], 6) AS a, round(x[2], 6) AS b FROM u""")
def vocabulary_substitutes(spark, sf):
    """A vocabulary with vectors, its unknown words by all three strategies."""
    words, model = _vocabulary(spark, sf)
    parts = [vectors.substitutes(words, model, s, 2).select(F.lit(s).alias("strategy"), "word", "index", *(F.round(F.get("vector", F.lit(i)), 6).alias(c) for i, c in enumerate("ab"))) for s in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(r"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '[.!?]'), lambda x: list_filter(string_split_regex(x, '[^a-z]+'), lambda w: w <> '')), lambda x: len(x) > 0)[1:3] AS s FROM benchmark),
        w AS (SELECT item_id, line, s[line][1:4] AS w FROM (SELECT item_id, s, unnest([1, 2, 3]) AS line FROM s)),
        x AS (SELECT item_id, line, list_transform([1, 2, 3, 4], lambda i: CASE WHEN w[i] IS NULL OR length(w[i]) < 3 THEN 0 ELSE length(w[i]) * 100 + ord(w[i]) END) AS ids FROM w)
        SELECT item_id, string_agg(array_to_string(ids, ' '), ',' ORDER BY line) AS ids FROM x GROUP BY item_id""")
def sentence_indices(spark, sf):
    """The first four words of the first three sentences as numbers, short words having none."""
    words = lambda c: F.filter(F.split(c, "[^a-z]+"), lambda w: w != "")
    lines = table(spark, sf, "benchmark").select("item_id", F.filter(F.transform(F.split(F.lower("text"), "[.!?]"), words), lambda x: F.size(x) > 0).alias("lines"))
    vocabulary = lines.select(F.explode(F.flatten("lines")).alias("word")).distinct().where(F.length("word") >= 3).select("word", (F.length("word") * 100 + F.ascii("word")).alias("index"))
    out = vectors.sentence_indices(lines, "item_id", "lines", vocabulary, 3, 4)
    return out.select("item_id", F.array_join(F.transform("ids", lambda x: F.array_join(x.cast("array<string>"), " ")), ",").alias("ids"))


@_query("""WITH w AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z]+')) AS word FROM part), a AS (SELECT word, row_number() OVER (ORDER BY word) AS r FROM (SELECT DISTINCT word FROM w WHERE length(word) > 4)), b AS (SELECT word, row_number() OVER (ORDER BY word DESC) AS r FROM (SELECT DISTINCT word FROM w WHERE length(word) > 3)),
        v AS (SELECT DISTINCT p_partkey, w.word, coalesce(a.r, 0) + coalesce(b.r, 0) AS r FROM w LEFT JOIN a USING (word) LEFT JOIN b USING (word) WHERE w.word <> '')
        SELECT p_partkey, string_agg(word, ' ' ORDER BY r, word) AS keywords FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY r, word) <= 2) GROUP BY p_partkey""")
def keywords_by_votes(spark, sf):
    """The two words of a part with the least sum of places in an alphabetical list and a reversed one."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    words = part.select(F.explode(T.letters_only(F.col("text"))).alias("word")).distinct()
    listed = lambda least, order: placed(words.where(F.length("word") > least), [order]).select("word", (F.col("place") + 1).alias("rank"))
    return corpus.keywords_by_votes(part, "p_partkey", listed(4, F.col("word")), listed(3, F.col("word").desc()), k=2)


@_query("SELECT p_partkey, p_brand AS p_name, p_brand, p_size FROM part")
def copied_column(spark, sf):
    return layouts.copied_column(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_name", "p_brand")


@_query("WITH w AS (SELECT p_brand AS word, count(*) AS freq FROM part GROUP BY 1) SELECT min(freq) AS least, sum(freq)::BIGINT AS total FROM w")
def frequency_bounds(spark, sf):
    """Counts of brands written as lines, read back as a list of frequencies."""
    path = new_folder(spark, "frequencies")
    counts = table(spark, sf, "part").groupBy(F.regexp_replace("p_brand", r"\s", "_").alias("word")).count()
    counts.select(F.concat_ws(" ", F.col("count").cast("string"), "word").alias("value")).write.text(path)
    return readers.frequency_bounds(readers.frequencies(spark, path))


@_query("""WITH d AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), t AS (SELECT DISTINCT p_brand || ' > ' || p_type AS path FROM part), w AS (SELECT path, unnest(string_split_regex(lower(path), '[^a-z0-9]+')) AS word FROM t UNION ALL SELECT path, unnest(string_split(lower(p_name), ' ')) FROM (SELECT DISTINCT p_brand || ' > ' || p_type AS path, p_name FROM part)),
        wt AS (SELECT path, word, count(*) AS y FROM w GROUP BY ALL), dt AS (SELECT p_partkey, word, count(*) AS x FROM d GROUP BY ALL), na AS (SELECT p_partkey, sqrt(sum(x * x)) AS a FROM dt GROUP BY 1), nb AS (SELECT path, sqrt(sum(y * y)) AS b FROM wt GROUP BY 1),
        s AS (SELECT p_partkey, path, round(sum(x * y) / any_value(a * b), 6) AS score FROM dt JOIN wt USING (word) JOIN na USING (p_partkey) JOIN nb USING (path) GROUP BY ALL)
        SELECT p_partkey, path, score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path) = 1""")
def nearest_taxonomy_path(spark, sf):
    """Names against the joined levels of a taxonomy, each path with its own words and those of its members."""
    part = table(spark, sf, "part")
    levels = vectors.taxonomy_paths(part, ["p_brand", "p_type"]).select("path", F.explode(F.split(F.lower("path"), "[^a-z0-9]+")).alias("word"))
    members = part.select(F.concat_ws(" > ", "p_brand", "p_type").alias("path"), "p_name").distinct().select("path", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    targets = levels.unionByName(members).groupBy("path", "word").agg(F.count("*").alias("weight"))
    return vectors.nearest_of_rows(part, "p_partkey", F.split(F.lower("p_name"), " "), targets, "path")


@_query()
def extra_tree_labels(spark, sf):
    """Classes of held-out vectors by a forest of random cuts on the others."""
    rows, train = _halves(spark, sf)
    forest = forests.extra_trees(train, "truth", "embedding", depth=6)
    return forests.decided(rows.where("vec_id % 3 = 0"), "embedding", forest).select("vec_id", "truth", "pred")


@_query("SELECT 'w' || vec_id AS word, len(embedding) AS columns, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last FROM embeddings")
def binary_word_vectors(spark, sf):
    """Vectors written in the binary form and read back by byte ranges."""
    path = new_folder(spark, "vectors")
    binary_vectors.write(table(spark, sf, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector")), path)
    back = binary_vectors.read(spark, path, split=1 << 20)
    numbers = F.transform("vector", lambda x: x.cast("double"))
    return back.select("word", F.size("vector").cast("long").alias("columns"), F.round(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.get(numbers, F.lit(0)), 5).alias("first"), F.round(F.element_at(numbers, -1), 5).alias("last"))


@_query()
def eliminated_columns(spark, sf):
    """Subsets of the vectors' columns by recursive elimination, with the share of rows that models of the other fold get right."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("truth"), "embedding")
    found = discriminative.eliminated(rows, "vec_id", "truth", "embedding", least=8, share=0.75, folds=2)
    return spark.createDataFrame([(len(c), c, round(good, 6)) for c, good in found], "columns int, kept array<int>, right double")
