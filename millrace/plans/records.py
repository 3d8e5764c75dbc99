"""Further queries with SQL: records, gold standards, samples and vectors made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus, entities, gold, layouts, learning, retrieval, scoring, vectors
from millrace.plans.queries import _ASCII, _HOST, _LN, _NAMES, _R, _W, _WORDS, NUMBER, _name_hits, _query, table
from millrace.sources import readers, sinks
from millrace.sources.tables import placed

_text = lambda *parts: F.concat(*(F.lit(p[1:-1]) if p.startswith("'") else F.col(p).cast("string") for p in parts))


# --- product records -------------------------------------------------------------------------------------------------

_KINDS = """CASE p_size % 3 WHEN 1 THEN 'der ' || p_type WHEN 2 THEN 'this is the ' || p_name || ' for you and it is of the type ' || p_type END"""


def _wide(spark, sf):
    """A record per part: a product's name or an offer's, and a description that is English, foreign or missing."""
    part = table(spark, sf, "part")
    return part.select(
        _text("'p|http://shop.example.com/'", "p_partkey").alias("id"),
        F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("product_name"),
        F.when(F.col("p_size") % 5 > 0, _text("'Offer '", "p_name")).alias("offer_name"),
        F.when(F.col("p_size") % 3 == 1, _text("'der '", "p_type")).when(F.col("p_size") % 3 == 2, _text("'this is the '", "p_name", "' for you and it is of the type '", "p_type")).alias("product_description"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("product_category"),
        F.col("p_brand").alias("offer_category"),
        F.lit("http://shop.example.com/x").alias("source_page"),
        F.lit("shop.example.com").alias("source_host"),
    )


@_query(f"""WITH w AS (SELECT 'p|http://shop.example.com/' || p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 1 THEN p_name END, CASE WHEN p_size % 5 > 0 THEN 'Offer ' || p_name END, '') AS name, {_KINDS} AS text FROM part)
        SELECT id, name, text FROM w WHERE text LIKE 'this is%' AND len(string_split(name, ' ')) >= 2""")
def name_description_rows(spark, sf):
    return entities.name_description_rows(_wide(spark, sf))


@_query("""WITH w AS (SELECT 'p|http://shop.example.com/' || p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN p_name END AS pn, CASE WHEN p_size % 5 > 0 THEN 'Offer ' || p_name END AS n, CASE WHEN p_size % 7 > 0 THEN p_type END AS pc, p_brand AS oc FROM part)
        SELECT id, pn AS name, pc AS category, 'http://shop.example.com/x' AS url FROM w WHERE pn IS NOT NULL AND pc IS NOT NULL
        UNION ALL SELECT id || '_sgoffer', n, oc, CASE WHEN pn IS NOT NULL AND pc IS NOT NULL THEN 'http://shop.example.com/x' END FROM w WHERE n IS NOT NULL""")
def product_and_offer_rows(spark, sf):
    return entities.name_category_rows(_wide(spark, sf)).select("id", "name", "category", "url")


@_query(f"""WITH r AS (SELECT 's|' || url AS id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'page no ' || page_id || ' of many' ELSE 'page' END AS name, CASE page_id % 2 WHEN 0 THEN NULL ELSE 'a text of so and so many words ' || page_id END AS text, {_HOST} AS host FROM pages)
        SELECT id, name, text, host FROM r WHERE (name IS NULL OR length(name) > 10) AND host IN (SELECT {_HOST} FROM pages GROUP BY 1 HAVING count(*) > 1)""")
def records_of_hosts(spark, sf):
    pages = table(spark, sf, "pages")
    rows = pages.select(
        _text("'s|'", "url").alias("id"),
        F.when(F.col("page_id") % 3 == 1, _text("'page no '", "page_id", "' of many'")).when(F.col("page_id") % 3 == 2, "page").alias("name"),
        F.when(F.col("page_id") % 2 == 1, _text("'a text of so and so many words '", "page_id")).alias("text"),
    )
    hosts = entities.host_facet(pages.select(T.host(F.col("url")).alias("host")), least=2).select("host")
    return entities.with_host(rows, hosts).select("id", "name", "text", "host")


_ENGLISH = "the of and to in is for with a this that it on are be by or as you your from an at"
_RATE = "len(list_filter({w}, lambda x: x IN (" + ", ".join(f"'{w}'" for w in _ENGLISH.split()) + "))) >= len({w}) * 0.1"


@_query(rf"""WITH p AS (SELECT {_ASCII.format(c="text")} AS t FROM documents UNION ALL SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Home' WHEN 1 THEN '. ' || n_name WHEN 2 THEN left(n_name, 2) ELSE 'the ' || n_name END FROM nation), w AS (SELECT t, string_split_regex(lower(t), '[^a-z'']+') AS w FROM p)
        SELECT CASE WHEN lower(t) IN ('product', 'home', 'null') THEN 'stop word' WHEN starts_with(t, '.') THEN 'unicode' WHEN length(t) < 3 THEN 'short' WHEN NOT {_RATE.format(w="w")} THEN 'language' ELSE 'kept' END AS reason, count(*) AS count FROM w GROUP BY 1""")
def rejection_counts(spark, sf):
    """All texts, and names of nations made to be refused for every reason."""
    n = F.col("n_nationkey") % 4
    made = table(spark, sf, "nation").select(F.when(n == 0, "Home").when(n == 1, F.concat(F.lit(". "), "n_name")).when(n == 2, F.substring("n_name", 1, 2)).otherwise(F.concat(F.lit("the "), "n_name")).alias("text"))
    return entities.rejections(table(spark, sf, "documents").select("text").unionByName(made), "text")


@_query("""WITH h AS (SELECT p_brand AS cluster, p_name AS title, CASE WHEN p_size > 25 THEN reverse(p_name) ELSE p_type END AS hit, p_type AS category FROM part)
        SELECT cluster, list_sort(list(DISTINCT category)) AS categories FROM h WHERE jaccard(lower(title), lower(hit)) > 0.9 GROUP BY cluster""")
def cluster_categories(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.reverse("p_name")).otherwise(F.col("p_type")).alias("hit"), F.col("p_type").alias("category"))
    return retrieval.cluster_categories(hits, "cluster", "title", "hit", "category")


@_query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rn FROM c)
        SELECT p_brand, list(p_name ORDER BY rn) AS titles FROM r WHERE rn <= 3 GROUP BY p_brand""")
def title_facet(spark, sf):
    return layouts.title_facet(table(spark, sf, "part"), "p_brand", "p_name", 3)


@_query("""SELECT 'cat_' || p_name AS ref_name, p_type AS category FROM part WHERE p_size > 20 UNION ALL SELECT p_name, NULL FROM part WHERE p_size <= 20""")
def annotation_rows(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_name").alias("ref_name"), F.col("p_type").alias("category"), "p_size")
    return retrieval.annotation_rows(part.where("p_size > 20").drop("p_size"), part.where("p_size <= 20").select("ref_name")).select("ref_name", "category")


@_query("SELECT l_partkey, l_orderkey, l_linenumber AS rank FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def each_document_once(spark, sf):
    hits = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", F.col("l_linenumber").alias("rank"))
    return retrieval.each_once(hits, "l_partkey", "l_orderkey")


@_query(f"""WITH c AS (SELECT p_partkey, {_ASCII.format(c="p_name")} AS n, repeat(p_type || ' ', p_size) AS t FROM part), k AS (SELECT p_partkey, n, trim(t) AS t FROM c)
        SELECT p_partkey, CASE WHEN length(n) > 10 AND len(string_split(n, ' ')) > 2 THEN n END AS name, CASE WHEN length(t) > 20 AND len(string_split(t, ' ')) > 5 THEN t END AS text FROM k
        WHERE (length(n) > 10 AND len(string_split(n, ' ')) > 2) OR (length(t) > 20 AND len(string_split(t, ' ')) > 5)""")
def export_minima(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.expr("repeat(concat(p_type, ' '), p_size)").alias("text"))
    return layouts.export_minima(rows)


@_query("""SELECT 'http://x/' || p_partkey AS "URL", p_name AS "Name", p_type AS "Site specific category", p_name || '!' AS "Description", p_brand AS "Lvl1", p_type AS "Lvl2", p_size::VARCHAR AS "Lvl3", 'N/A' AS "Solr index", 'N/A' AS "Record ID" FROM part""")
def gold_layout(spark, sf):
    part = table(spark, sf, "part")
    return layouts.gold_layout(part.select(_text("'http://x/'", "p_partkey").alias("url"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), _text("p_name", "'!'").alias("description"), F.col("p_brand").alias("lvl1"), F.col("p_type").alias("lvl2"), F.col("p_size").cast("string").alias("lvl3")))


@_query("""SELECT p_partkey, coalesce(p_name, '') || '. ' || coalesce(CASE WHEN p_size > 9 THEN p_type END, '') || '. ' || p_brand AS text FROM part""")
def joined_fields(spark, sf):
    part = table(spark, sf, "part").withColumn("type", F.expr("CASE WHEN p_size > 9 THEN p_type END"))
    return layouts.joined_texts(part, ["p_name", "type", "p_brand"]).select("p_partkey", "text")


@_query("""SELECT p_partkey, p_name, n AS sold, trim(p_type) AS p_type FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON p_partkey = l_partkey""")
def merged_label_last(spark, sf):
    left = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_type").alias("p_type"), "p_name")
    right = table(spark, sf, "lineitem").where("l_quantity > 30").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold"))
    return layouts.merged_label_last(left, right, "p_partkey", "p_type")


@_query("""SELECT doc_id, CASE WHEN len(string_split(t, ' ')) > 5 OR t IS NULL THEN '' ELSE t END AS category FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN substr(text, 1, 30) END AS t FROM documents)""")
def short_categories(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.substring("text", 1, 30)).alias("category"))
    return layouts.short_categories(docs, "category")


@_query("""SELECT p_partkey + 1 AS line_no, CASE WHEN p_partkey % 10 = 0 THEN 'INDEX;name' ELSE p_name END AS value FROM part WHERE p_partkey = 0 OR p_partkey % 10 > 0""")
def header_lines(spark, sf):
    lines = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("line_no"), F.when(F.col("p_partkey") % 10 == 0, "INDEX;name").otherwise(F.col("p_name")).alias("value"))
    return layouts.without_header_lines(lines)


@_query("SELECT DISTINCT coalesce(CASE WHEN p_size % 9 > 0 THEN p_type END, 'NONE') AS category FROM part")
def category_set(spark, sf):
    part = table(spark, sf, "part").withColumn("c", F.expr("CASE WHEN p_size % 9 > 0 THEN p_type END"))
    return layouts.category_set(part, "c", stem=False)


# --- text rules ------------------------------------------------------------------------------------------------------

_MT = r"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9{k}]', ' ', 'g'), '\s+', ' ', 'g'))"
_MASK = rf"regexp_replace(regexp_replace({{c}}, '{_LN}', 'LETTERNUMBER', 'g'), '{NUMBER}', 'NUMBER', 'g')"
_TOO_MANY = rf"len(regexp_extract_all({{c}}, '{NUMBER}')) + len(regexp_extract_all({{c}}, '{_LN}')) > len(string_split({{m}}, ' ')) / 3"


@_query(rf"""WITH t AS (SELECT p_partkey, p_name || ' x200 ' || p_type AS t, p_name || ' > ' || p_type || ' > ' || p_brand AS c FROM part),
        n AS (SELECT p_partkey, t, lower({_MT.format(c="t", k="")}) AS p, {_MT.format(c="lower(t)", k=":,.;")} AS f, lower({_MT.format(c="c", k="|>/")}) AS q FROM t),
        m AS (SELECT *, {_MASK.format(c="p")} AS pm, {_MASK.format(c="f")} AS fm, {_MASK.format(c="q")} AS qm FROM n)
        SELECT p_partkey, CASE WHEN len(string_split(pm, ' ')) BETWEEN 2 AND 10 AND NOT {_TOO_MANY.format(c="p", m="pm")} THEN pm END AS name,
        coalesce(nullif(array_to_string(list_filter(string_split(fm, ' '), lambda x: length(x) > 2), ' '), ''), 'EMPTY') AS filtered,
        CASE WHEN len(string_split(qm, ' ')) BETWEEN 2 AND 10 AND NOT {_TOO_MANY.format(c="q", m="qm")} AND length(q) >= 3
             THEN array_to_string(list_transform(list_filter(list_transform(string_split_regex(qm, '[|>/-]+'), lambda x: trim(lower(x))), lambda x: length(x) > 2), lambda x: replace(x, ' ', '_')), ' ') END AS category FROM m""")
def mt_normal_forms(spark, sf):
    part = table(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", F.lit("x200"), "p_type")
    return part.select("p_partkey", T.mt_name(text).alias("name"), T.mt_name_filter(text).alias("filtered"), T.mt_category(F.concat_ws(" > ", "p_name", "p_type", "p_brand")).alias("category"))


@_query(r"""SELECT p_partkey, regexp_replace(lower(p_name) || ' ab12 ' || p_size || ' ' || p_type_l, '\bab12\b', 'LETTERNUMBER').replace(' ' || p_size || ' ', ' NUMBER ') AS name FROM (SELECT *, lower(p_type) AS p_type_l FROM part)""")
def mt_short_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.mt_short_name(_text("p_name", "' AB12 - '", "p_size", "' '", "p_type")).alias("name"))


@_query(r"""SELECT p_partkey, p_name || ' ' || p_type || ' > ' || p_brand AS category, CASE WHEN p_size % 2 = 0 THEN 'crumb' ELSE p_type END AS chosen FROM part""")
def category_or_breadcrumb(spark, sf):
    part = table(spark, sf, "part")
    cat = F.when(F.col("p_size") % 4 == 0, _text("'http://'", "p_type")).when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    return part.select("p_partkey", T.category(_text("p_name", "'%20'", "p_type", "'<br> › '", "p_brand")).alias("category"), T.category_or_breadcrumb(cat, F.lit("crumb")).alias("chosen"))


_TEXT = r"replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


@_query(rf"""WITH t AS (SELECT page_id, {_MT.format(c=f"lower({_TEXT})", k=":,.;")} AS p FROM pages), n AS (SELECT *, len(string_split(p, ' ')) AS n, len(regexp_extract_all(p, '{NUMBER}')) + len(regexp_extract_all(p, '{_LN}')) AS m FROM t)
        SELECT page_id, CASE WHEN NOT m >= n // 3 AND n BETWEEN 5 AND 200 THEN {_MASK.format(c="p")} END AS text FROM n""")
def page_descriptions(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.full_description(F.col("html")).alias("text"))


_SIGNS = ("//", " ?", "::", ":", "›", "»", "|", "/ ", "  ")


@_query("""SELECT p_partkey, sign, p_name || ' > ' || p_type AS crumb FROM part, (SELECT unnest(['//', ' ?', '::', ':', '›', '»', '|', '/ ', '  ']) AS sign)""")
def breadcrumb_separators(spark, sf):
    part = table(spark, sf, "part").withColumn("sign", F.explode(F.array(*map(F.lit, _SIGNS))))
    return part.select("p_partkey", "sign", T.breadcrumb(F.concat("p_name", F.lit(" "), "sign", F.lit(" "), "p_type")).alias("crumb"))


@_query(r"""WITH s AS (SELECT doc_id, string_split(text, '.') AS s, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM documents)
        SELECT doc_id, array_to_string(s[1:2], '. ') AS first, CASE WHEN length(w) <= 60 THEN w ELSE regexp_extract(w, '^(.{0,54})(?: |$)', 1) || ' [...]' END AS short FROM s""")
def first_sentences_and_shortened(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentences(F.col("text"), 2).alias("first"), T.shorten(F.col("text"), 60).alias("short"))


@_query("SELECT p_partkey, translate(p_name || '>' || p_type || '_' || p_brand, '>_', '  ') AS words FROM part")
def label_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.label_words(_text("p_name", "'>'", "p_type", "'_'", "p_brand")).alias("words"))


@_query(rf"""WITH h AS (SELECT page_id, list_filter(string_split({_HOST}, '.'), lambda x: length(x) > 3) AS l, string_split_regex(lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '[^a-z0-9]+') AS p FROM pages)
        SELECT page_id, array_to_string(list_concat(CASE WHEN len(l) > 0 THEN [list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1]] ELSE [] END, list_filter(p, lambda x: length(x) >= 3 AND x NOT IN ('html', 'htm', 'aspx', 'asp', 'jsp', 'cgi'))), ' ') AS words FROM h""")
def url_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.url_words(F.col("url")), " ").alias("words"))


@_query(r"""SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 40 AND len(string_split_regex(text, '\s+')) > 8 THEN array_to_string(string_split_regex(text, '\s+')[1:5], ' ') END AS first FROM documents""")
def large_enough_beginnings(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(T.large_enough(T.collapse(text), 40, 0) & (F.size(T.tokens(text)) > 8), T.first_words(text, 5)).alias("first"))


@_query(f"""WITH {_NAMES}, o AS (SELECT query, hit FROM rk WHERE rank <= 20 AND lower(query) <> lower(hit) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 10),
        f AS (SELECT query, word, count(*) AS n FROM (SELECT query, unnest(string_split(lower(hit), ' ')) AS word FROM o) GROUP BY ALL),
        w AS (SELECT p_name AS query, unnest(string_split(lower(p_name), ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM p)
        SELECT w.query, w.word AS attributes FROM w LEFT JOIN f ON w.query = f.query AND w.word = f.word WHERE length(w.word) >= 3 QUALIFY row_number() OVER (PARTITION BY w.query ORDER BY coalesce(n, 0) DESC, pos DESC) = 1""")
def attribute_extractor(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("query")).distinct()
    return retrieval.name_attributes(names.withColumn("name", F.col("query")), _name_hits(spark, sf, 20), "query", "name", "hit_name", 1, 10)


# --- readers and sinks -----------------------------------------------------------------------------------------------


@_query("""SELECT p_partkey AS "ID", p_name AS "Name", CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS "Desc", p_brand AS "Brand", '' AS "Manufacturer", 'u' AS "URL", p_type AS "lvl1" FROM part""")
def cluster_offers(spark, sf):
    entry = lambda name, c: F.create_map(F.lit(name), F.concat(F.lit("["), c, F.lit("]")))
    own = F.array(entry("/other", F.col("p_type")), entry("/name", F.lit("first")), entry("/name", F.col("p_name")))
    parent = F.array(entry("/brand", F.col("p_brand")), entry("/brand", F.lit("later")), F.when(F.col("p_size") % 2 == 0, entry("/description", F.col("p_type"))).otherwise(entry("/x", F.lit("y"))))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("cluster_id"), F.lit("u").alias("url"), F.col("p_type").alias("categoryLabel"), own.alias("schema.org_properties"), parent.alias("parent_schema.org_properties"))
    return readers.cluster_offers(rows)


@_query("SELECT p_partkey AS cluster_id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS name FROM part")
def offer_names(spark, sf):
    entry = lambda name, c: F.create_map(F.lit(name), F.concat(F.lit("["), F.col(c), F.lit("]")))
    props = F.when(F.col("p_size") % 2 == 0, F.array(entry("/title", "p_brand"), entry("/name", "p_name"))).otherwise(F.array(entry("/x", "p_brand"), entry("/name", "p_name")))
    return readers.offer_names(table(spark, sf, "part").select(F.col("p_partkey").alias("cluster_id"), props.alias("schema.org_properties")))


@_query("SELECT p_partkey AS label, p_name || ' ' || p_type AS left, p_brand AS right FROM part")
def pair_sides(spark, sf):
    return readers.pair_sides(table(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_name").alias("left_name"), F.col("p_type").alias("left_type"), F.col("p_brand").alias("right_brand")))


@_query("SELECT DISTINCT p_name AS name FROM part WHERE p_size > 2")
def distinct_tasks(spark, sf):
    return readers.tasks(table(spark, sf, "part").select(F.expr("CASE WHEN p_size > 2 THEN concat(p_name, ' --') ELSE '-' END").alias("name")))


@_query("""SELECT 'train' AS split, count(*) AS n FROM part WHERE p_size < 40 UNION ALL SELECT 'test', count(*) FROM part WHERE p_size >= 40""")
def train_and_test(spark, sf):
    part = table(spark, sf, "part")
    return readers.train_and_test(part.where("p_size < 40"), part.where("p_size >= 40")).groupBy("split").agg(F.count("*").alias("n"))


@_query("""SELECT s_name AS name, NULL AS mktsegment, 'supplier' AS source_entity_index FROM supplier UNION ALL SELECT c_name, c_mktsegment, 'customer' FROM customer""")
def union_of_indices(spark, sf):
    return readers.union_of({"supplier": table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "customer": table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mktsegment"))})


@_query("""SELECT p_partkey, len(string_split(p_name, ' ')) AS name_words, len(string_split(p_type, ' ')) AS desc_words FROM part WHERE p_size > 5""")
def word_log(spark, sf):
    return sinks.word_log(table(spark, sf, "part").withColumn("d", F.expr("CASE WHEN p_size > 5 THEN p_type ELSE ' ' END")), "p_partkey", "p_name", "d")


@_query("SELECT p_partkey, p_name, p_partkey % 7 AS part FROM part")
def sliced_lines(spark, sf):
    return sinks.slice_lines(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 7)


@_query("SELECT quality AS pred, toxic AS truth, CASE WHEN quality = toxic THEN 'ok' ELSE 'wrong' END AS flag, count(*) AS n FROM labels GROUP BY ALL")
def prediction_flags(spark, sf):
    return sinks.predictions(table(spark, sf, "labels"), "quality", "toxic").groupBy("pred", "truth", "flag").agg(F.count("*").alias("n"))


@_query("""SELECT 'w' || vec_id AS word, len(embedding) + 1 AS columns, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def embedding_lines(spark, sf):
    lines = sinks.embedding_lines(table(spark, sf, "embeddings").select(_text("'w'", "vec_id").alias("word"), F.col("embedding").alias("vector")))
    parts = lines.select(F.split("line", " ").alias("p")).select(F.get("p", F.lit(0)).alias("word"), F.size("p").cast("long").alias("columns"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.cast("float").cast("double")).alias("v"))
    return parts.select("word", "columns", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.element_at("v", -1), 5).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@_query("SELECT p_partkey, p_name, p_type FROM part")
def repaired_cells(spark, sf):
    return sinks.repair_cells(table(spark, sf, "part").select("p_partkey", _text("p_name", "'\"\"'").alias("p_name"), _text("p_type", "'\"'").alias("p_type")))


# --- statistics ------------------------------------------------------------------------------------------------------


@_query(r"""WITH s AS (SELECT u.text AS l, a.text AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1), n AS (SELECT len(string_split_regex(trim(t), '\s+')) AS n FROM (SELECT l AS t FROM s UNION ALL SELECT r FROM s))
        SELECT max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean FROM n""")
def pair_side_stats(spark, sf):
    turns = table(spark, sf, "conversations")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("left")).join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right")), ["conv_id", "turn"])
    return corpus.side_stats(pairs).select(F.col("most").cast("long").alias("most"), F.col("least").cast("long").alias("least"), F.round("mean", 6).alias("mean"))


@_query(f"""WITH s AS (SELECT 'p_name' AS side, p_name AS text FROM part UNION ALL SELECT 'p_type', p_type FROM part), w AS (SELECT side, list_filter({_WORDS}, lambda x: x <> '') AS w FROM s), e AS (SELECT side, unnest(w) AS word FROM w)
        SELECT e.side, count(*) AS words, count(DISTINCT word) AS distinct_words, any_value(m) AS median_words FROM e JOIN (SELECT side, quantile_cont(len(w), 0.5) AS m FROM w GROUP BY side) q ON e.side = q.side GROUP BY e.side""")
def unique_word_counts(spark, sf):
    return corpus.unique_word_counts(table(spark, sf, "part"), ["p_name", "p_type"])


@_query("SELECT p_brand AS level, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS variant, round(avg(p_size / 50), 8) AS ratio FROM part GROUP BY ALL")
def mean_ratio(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("level"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("variant"), (F.col("p_size") / 50).alias("ratio"))
    return corpus.mean_ratio(rows).withColumn("ratio", F.round("ratio", 8))


@_query(r"""WITH t AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_brand || ' #' || p_type), '#(\w+)', 1)) AS tag FROM part), c AS (SELECT DISTINCT tag, 'c' || length(tag) AS condition FROM t)
        SELECT p_partkey, count(DISTINCT condition) AS conditions FROM t JOIN c USING (tag) GROUP BY p_partkey""")
def hashtag_conditions(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", _text("p_brand", "' #'", "p_type").alias("text"))
    tags = rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"#(\w+)"), F.lit(1))).alias("tag")).distinct()
    return corpus.hashtag_conditions(rows, "p_partkey", tags.withColumn("condition", F.concat(F.lit("c"), F.length("tag").cast("string"))))


@_query("""WITH d AS (SELECT p_name || p_size AS label, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM part) SELECT label, min(split) AS split FROM d GROUP BY label HAVING count(*) = 1""")
def isolated_classes(spark, sf):
    rows = table(spark, sf, "part").select(_text("p_name", "p_size").alias("label"), F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train").alias("split"))
    return gold.isolated_classes(rows, "label")


@_query(rf"""WITH {_R}, k AS (SELECT word, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM ref WHERE length(word) > 4), w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents),
        r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY rank, word) AS "at" FROM w JOIN k USING (word)), s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY "at") AS keywords FROM r WHERE "at" <= 3 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(keywords, 'unknown') AS keywords FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def keywords_by_rank(spark, sf):
    words = corpus.word_frequency(table(spark, sf, "benchmark")).where(F.length("word") > 4)
    ranks = placed(words, [F.desc("freq"), "word"], out="rank")
    return corpus.keywords_by_rank(table(spark, sf, "documents"), "doc_id", ranks)


@_query(r"""WITH s AS (SELECT p_partkey, p_brand, p_name AS x, 0 AS "at" FROM part UNION ALL SELECT p_partkey, p_brand, p_type, 1 FROM part), w AS (SELECT p_partkey, p_brand, x, "at", unnest(regexp_extract_all(lower(x), '\b\w\w+\b')) AS word FROM s),
        n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), d AS (SELECT p_brand, word, count(DISTINCT p_partkey) AS df FROM w GROUP BY ALL), i AS (SELECT p_brand, word, ln((1 + n) / (1 + df)) + 1 AS idf FROM d JOIN n USING (p_brand)),
        m AS (SELECT p_partkey, x, "at", round(avg(idf), 9) AS score FROM w JOIN i USING (p_brand, word) GROUP BY ALL) SELECT p_partkey, x AS category FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, "at" DESC) = 1""")
def best_category_part(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", F.array("p_name", "p_type").alias("parts"))
    return corpus.best_category_part(rows, "p_partkey", "p_brand", "parts")


# --- gold standards --------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, quality FROM labels WHERE ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.3")
def line_sample(spark, sf):
    return gold.line_sample(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 0.3)


@_query("SELECT p_partkey, p_name FROM part WHERE p_size % 4 > 1")
def described_rows(spark, sf):
    part = table(spark, sf, "part").withColumn("d", F.expr("CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ab ' WHEN 2 THEN 'abc' ELSE p_type END"))
    return gold.with_description(part, "d").select("p_partkey", "p_name")


@_query("SELECT p_partkey, '1_' || p_type AS label FROM part WHERE p_size % 3 = 0")
def valid_annotations(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.expr("CASE p_size % 3 WHEN 0 THEN concat('1_', p_type) WHEN 1 THEN ' ' ELSE replace(p_type, '_', '') END").alias("label"))
    return gold.valid_annotations(part, "label")


@_query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name DESC) - 1 AS place FROM supplier) SELECT place, p_partkey, s_name FROM a JOIN b USING (place)""")
def joined_by_position(spark, sf):
    names = table(spark, sf, "supplier").select("s_name", F.lpad((F.lit(10_000_000) - F.col("s_suppkey")).cast("string"), 9, "0").alias("key"))
    return gold.join_by_position(table(spark, sf, "part").select("p_partkey"), names, "p_partkey", "key").select("place", "p_partkey", "s_name")


@_query("SELECT p_partkey, 'One ' || p_name || '.  Two' AS generated FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 10 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 10) UNION ALL SELECT p_partkey, 'One ' || p_name || '.  Two' FROM part WHERE p_size <= 10 AND p_name IN (SELECT p_name FROM part WHERE p_size > 10)")
def appended_texts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    texts = part.where("p_size > 10").select(F.lower("p_name").alias("name"), _text("'One '", "p_name", "'. Two. Three.'").alias("text"))
    return gold.append_generated(part, texts, F.lower("p_name"), 2).select("p_partkey", "generated")


@_query("""WITH t AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) SELECT CASE WHEN p_partkey IN (SELECT l_partkey FROM t) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1""")
def split_by_clusters(spark, sf):
    clusters = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("cluster_id")).distinct()
    train, test = gold.split_by_clusters(table(spark, sf, "part").withColumn("cluster_id", F.col("p_partkey")), clusters)
    return readers.train_and_test(train, test).groupBy("split").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_PW = "pw AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)"
_VEC = "vw AS (SELECT word, [length(word), ord(word) % 7, 1.5]::DOUBLE[] AS v FROM (SELECT DISTINCT word FROM pw) WHERE length(word) % 3 > 0)"


def _part_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


def _word_vectors(spark, sf):
    words = _part_words(spark, sf).select("word").distinct().where(F.length("word") % 3 > 0)
    return words.select("word", F.array(F.length("word").cast("double"), (F.ascii("word") % 7).cast("double"), F.lit(1.5)).alias("vector"))


@_query(f"""WITH {_PW}, {_VEC} SELECT p_partkey, sum(v[1]) AS a, sum(v[2]) AS b, sum(v[3]) AS c FROM pw JOIN vw USING (word) GROUP BY p_partkey""")
def embedded_sums(spark, sf):
    out = vectors.embed_text(_part_words(spark, sf), _word_vectors(spark, sf), "p_partkey")
    return out.select("p_partkey", *(F.get("vector", F.lit(i)).alias(c) for i, c in enumerate("abc")))


@_query(f"""WITH {_PW}, {_VEC}, x AS (SELECT p_partkey, word, length(word) / 10 AS w FROM pw) SELECT p_partkey, round(sum(v[1] * w), 6) AS a, round(sum(v[2] * w), 6) AS b, round(sum(v[3] * w), 6) AS c FROM x JOIN vw USING (word) GROUP BY p_partkey""")
def weighted_embeddings(spark, sf):
    words = _part_words(spark, sf).withColumn("w", F.length("word") / 10)
    out = vectors.embed_text(words, _word_vectors(spark, sf), "p_partkey", weight="w")
    return out.select("p_partkey", *(F.round(F.get("vector", F.lit(i)), 6).alias(c) for i, c in enumerate("abc")))


@_query(f"""WITH {_PW}, {_VEC}, l AS (SELECT p_partkey, word, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY pos DESC) AS back, count(*) OVER (PARTITION BY p_partkey) AS n FROM pw),
        f AS (SELECT p_partkey, least(n, 3) - back AS row, coalesce(v, [9, 9, 9]::DOUBLE[]) AS v FROM l LEFT JOIN vw USING (word) WHERE back <= 3), r AS (SELECT p_partkey, unnest([0, 1, 2]) AS row FROM part)
        SELECT p_partkey, string_agg(array_to_string(list_transform(coalesce(v, [0, 0, 0]::DOUBLE[]), lambda x: round(x * 10)::INT), ' '), ',' ORDER BY row) AS tenths FROM r LEFT JOIN f USING (p_partkey, row) GROUP BY p_partkey""")
def sequence_matrices(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    vec = _word_vectors(spark, sf).withColumn("vector", F.col("vector").cast("array<float>"))
    substitute = F.array(*(F.lit(9.0).cast("float") for _ in range(3)))
    out = vectors.sequence_matrix(rows, vec, "p_partkey", "words", 3, 3, substitute)
    row = lambda r: F.array_join(F.transform(r, lambda x: F.round(x * 10).cast("int").cast("string")), " ")
    return out.select("p_partkey", F.array_join(F.transform("matrix", row), ",").alias("tenths"))


@_query(f"""WITH {_PW}, k AS (SELECT word, row_number() OVER (ORDER BY word) AS i FROM (SELECT DISTINCT word FROM pw WHERE length(word) > 4)), s AS (SELECT p_partkey, pos, coalesce(i, 0) AS i FROM pw LEFT JOIN k USING (word) WHERE pos < 3)
        SELECT p_partkey, string_agg(i::VARCHAR, ',' ORDER BY pos) || repeat(',0', 3 - count(*)) AS ids FROM s GROUP BY p_partkey""")
def word_indices(spark, sf):
    words = _part_words(spark, sf).select("word").distinct().where(F.length("word") > 4)
    vocabulary = placed(words, ["word"]).select("word", (F.col("place") + 1).cast("int").alias("index"))
    out = vectors.word_indices(table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words")), "p_partkey", "words", vocabulary, 3)
    return out.select("p_partkey", F.array_join("ids", ",").alias("ids"))


@_query(f"""WITH {_PW}, {_VEC} SELECT word, coalesce(v[1], -1) AS x, coalesce(v[2], 0) AS y, coalesce(v[3], 0) AS z FROM (SELECT DISTINCT word FROM pw) LEFT JOIN vw USING (word)""")
def vocabulary_vectors(spark, sf):
    words = _part_words(spark, sf).select("word").distinct().withColumn("index", F.lit(0))
    out = vectors.vocabulary_matrix(words, _word_vectors(spark, sf), F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)))
    return out.select("word", *(F.get("vector", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


@_query(f"""WITH {_PW}, {_VEC} SELECT p_partkey, coalesce(v[1], 0) AS x, coalesce(v[3], 0) AS z FROM part LEFT JOIN vw ON string_split(p_name, ' ')[1] = word""")
def looked_up_vectors(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.get(F.split("p_name", " "), F.lit(0)).alias("word"))
    out = vectors.looked_up(rows, _word_vectors(spark, sf), "word", 3)
    return out.select("p_partkey", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(2)).alias("z"))


@_query(f"""WITH {_PW}, k AS (SELECT word, row_number() OVER (ORDER BY word) AS position FROM (SELECT DISTINCT word FROM pw WHERE length(word) > 4)) SELECT p_partkey, pos, word, round(coalesce(pow(100 - position, 2) / 10000.0, 0.5), 8) AS weight FROM pw LEFT JOIN k USING (word)""")
def rank_weights(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    ranks = placed(words.select("word").distinct().where(F.length("word") > 4), ["word"]).select("word", (F.col("place") + 1).alias("position"))
    return vectors.rank_weights(words, ranks, 100).select("p_partkey", F.col("pos").cast("long").alias("pos"), "word", F.round("weight", 8).alias("weight"))


@_query(f"""WITH {_PW}, t AS (SELECT p_partkey, word, count(*) AS tf FROM pw GROUP BY ALL), n AS (SELECT count(DISTINCT p_partkey) AS n FROM pw), d AS (SELECT word, count(*) AS df FROM t GROUP BY word),
        k AS (SELECT p_partkey, word, tf * (ln(n / df) + 1) AS x FROM t JOIN d USING (word), n) SELECT p_partkey, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS normed, round(x / max(x) OVER (PARTITION BY word), 6) AS scaled FROM k""")
def normed_and_scaled_tfidf(spark, sf):
    weights = vectors.tfidf(_part_words(spark, sf), "p_partkey")
    a = vectors.normed(weights, "p_partkey").select("p_partkey", "word", F.round("weight", 6).alias("normed"))
    return a.join(vectors.scaled(weights).select("p_partkey", "word", F.round("weight", 6).alias("scaled")), ["p_partkey", "word"])


@_query(f"""WITH {_W}, b AS (SELECT item_id, unnest({_WORDS}) AS word FROM benchmark), bt AS (SELECT item_id, word, count(*) AS tf FROM b WHERE word <> '' GROUP BY ALL), n AS (SELECT count(DISTINCT item_id) AS n FROM bt),
        idf AS (SELECT word, ln(any_value(n) / count(*)) + 1 AS idf FROM bt, n GROUP BY word), q AS (SELECT item_id, word, tf * idf AS y FROM bt JOIN idf USING (word)), dt AS (SELECT doc_id, word, count(*) * any_value(idf) AS x FROM v JOIN idf USING (word) GROUP BY doc_id, word),
        na AS (SELECT doc_id, sqrt(sum(x * x)) AS a FROM dt GROUP BY 1), nb AS (SELECT item_id, sqrt(sum(y * y)) AS b FROM q GROUP BY 1), dots AS (SELECT doc_id, item_id, sum(x * y) AS dot FROM dt JOIN q USING (word) GROUP BY ALL),
        s AS (SELECT doc_id, item_id, round(dot / (a * b), 6) AS score FROM dots JOIN na USING (doc_id) JOIN nb USING (item_id))
        SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""")
def tfidf_nearest_path(spark, sf):
    items = corpus.word_counts(table(spark, sf, "benchmark"), "item_id")
    n = items.select("item_id").distinct().count()
    idf = items.groupBy("word").agg((F.log(F.lit(float(n)) / F.count("*")) + 1).alias("factor"))
    weighed = items.join(idf, "word").select("item_id", "word", (F.col("n") * F.col("factor")).alias("weight"))
    return vectors.nearest_of_rows(table(spark, sf, "documents"), "doc_id", corpus.words_of("text"), weighed, "item_id", idf)


@_query("""WITH s AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_size, ' ') AS s FROM part)
        SELECT p_partkey, array_to_string(list_concat(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]), list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 2])), ',') AS pairs FROM s""")
def skip_pairs(spark, sf):
    words = F.split(_text("p_name", "' '", "p_type", "' '", "p_size"), " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(vectors.skip_pairs(words), ",").alias("pairs"))


@_query("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 = 0")
def broken_features(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")))
    return scoring.broken_features(rows, "embedding").select("vec_id", "label")


# --- learning --------------------------------------------------------------------------------------------------------

_HOLD = "h AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM part)"


@_query(f"""WITH {_HOLD}, c AS (SELECT p_type, count(*) AS n FROM h WHERE split = 'train' AND p_type <> 'PROMO' GROUP BY 1), top AS (SELECT arg_max(p_type, n) AS t FROM c),
        x AS (SELECT p_type AS truth, CASE WHEN p_type IN (SELECT p_type FROM c) THEN p_type ELSE (SELECT t FROM top) END AS pred FROM h WHERE split = 'test') SELECT pred, truth, count(*) AS n FROM x GROUP BY ALL""")
def holdout_of_an_unseen_class(spark, sf):
    """A model of types by their own names; training lacks one class, whose test rows are told the commonest."""
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    train = learning.word_columns(part.where("p_partkey % 3 <> 0 AND p_type <> 'PROMO'"), [("p_type", None)])
    test = learning.word_columns(part.where("p_partkey % 3 = 0"), [("p_type", None)])
    found = learning.fit(train, "nb", "p_type", learning.hashed()).transform(test)
    return found.groupBy("pred", F.col("p_type").alias("truth")).agg(F.count("*").alias("n"))


@_query("""WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS q, avg(toxic) AS t FROM labels WHERE doc_id NOT BETWEEN 10 AND 49 AND doc_id NOT BETWEEN 100 AND 139), e AS (SELECT *, q * t + (1 - q) * (1 - t) AS pe FROM t)
        SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM e""")
def cohen_kappa_of_ranges(spark, sf):
    return scoring.kappa(table(spark, sf, "labels"), "quality", "toxic", "doc_id", ((10, 50), (100, 140)))


@_query(rf"""WITH {_R}, s AS (SELECT 'left' AS side, u.text AS t FROM conversations u WHERE role = 'user' UNION ALL SELECT 'right', role || ' says ' || left(text, 40) FROM conversations WHERE role = 'user'),
        w AS (SELECT side, unnest(string_split_regex(lower(t), '[^a-z]+')) AS word FROM s), c AS (SELECT side, count(*) AS clean, count(ref.word) AS known FROM w LEFT JOIN ref ON w.word = ref.word WHERE w.word <> '' GROUP BY side),
        n AS (SELECT side, count(*) AS rows, sum(len(string_split_regex(trim(t), '\s+'))) AS tokens FROM s GROUP BY side) SELECT side, round(tokens / rows, 6) AS tokens, round(clean / rows, 6) AS clean, round(known / rows, 6) AS known FROM n JOIN c USING (side)""")
def pair_word_stats(spark, sf):
    pairs = table(spark, sf, "conversations").where("role = 'user'").select(F.col("text").alias("left"), F.concat("role", F.lit(" says "), F.substring("text", 1, 40)).alias("right"))
    out = corpus.pair_stats(pairs, corpus.word_frequency(table(spark, sf, "benchmark")))
    return out.select("side", *(F.round(c, 6).alias(c) for c in ("tokens", "clean", "known")))


@_query("SELECT p_partkey, p_name AS name, p_type AS category, CASE WHEN p_size > 20 THEN lower(p_brand) ELSE '' END AS keywords FROM part WHERE lower(p_name) <> lower(p_type)")
def example_rows(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("category"), "p_size", "p_brand")
    keywords = part.where("p_size > 20").select("p_partkey", F.lower("p_brand").alias("keywords"))
    return layouts.examples(part.where(T.differs(F.col("name"), F.col("category"))), keywords, "p_partkey", "name", "category")


@_query("""SELECT p_partkey::VARCHAR AS file, 'mac avg' AS measure, p_size / 100 AS p, 0.5::DOUBLE AS r, 0.25::DOUBLE AS f1 FROM part UNION ALL SELECT p_partkey::VARCHAR, 'accuracy', p_size / 50, p_size / 50, p_size / 50 FROM part""")
def score_file_lines(spark, sf):
    number = lambda d: (F.col("p_size") / d).cast("string")
    lines = F.array(F.concat(F.lit("mac avg, "), number(100), F.lit(", 0.5, 0.25")), F.concat(F.lit("accuracy="), number(50)), F.lit("other, 1"))
    return scoring.score_lines(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), F.explode(lines).alias("value")))
