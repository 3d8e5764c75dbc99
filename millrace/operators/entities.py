"""From quads to entities to product records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.constants import EMPTY_NAMES, FIELDS


def parse_quads(lines: DataFrame) -> DataFrame:
    """s, p, o, tag, source, file, line_no of quad lines; lines of fewer than four parts go.

    A literal is what stands between the first and the last quote; its language tag and the page follow.
    """
    v = F.col("value")
    # each line is matched once: its groups, put between marks, are split off; the literal comes last and may hold anything
    cut = F.split(F.regexp_replace(v, r'^(\S+)\s+(\S+)\s+"(.*)"(\S*)\s+(.*)\s*$', "$1\x01$2\x01$4\x01$5\x01$3"), "\x01", 5)
    plain = F.when(~v.contains('"'), F.split(F.trim(v), r"\s+"))
    rows = lines.select("file", "line_no", cut.alias("cut"), plain.alias("plain"))
    literal = (F.size("cut") == 5) & F.col("plain").isNull()
    rows = rows.withColumn("literal", literal).where(F.col("literal") | (F.size("plain") >= 4))
    get = lambda i, j: F.when(F.col("literal"), F.get("cut", F.lit(i))).otherwise(F.get("plain", F.lit(j)))
    page = F.regexp_extract(F.get("cut", F.lit(3)), r"^<?([^>]*?)(?:>.*|\s*\.?\s*)$", 1)
    return rows.select(
        bracketless(get(0, 0)).alias("s"),
        bracketless(get(1, 1)).alias("p"),
        F.when(F.col("literal"), F.get("cut", F.lit(4))).otherwise(bracketless(F.get("plain", F.lit(2)))).alias("o"),
        F.when(F.col("literal"), F.get("cut", F.lit(2))).otherwise(F.lit("")).alias("tag"),
        F.when(F.col("literal"), page).otherwise(bracketless(F.get("plain", F.lit(3)))).alias("source"),
        "literal",
        "file",
        "line_no",
    )


def bracketless(c: Column) -> Column:
    begin, end = c.startswith("<").cast("int"), c.endswith(">").cast("int")
    return F.when(begin + end > 0, F.substring(c, begin + 1, F.length(c) - begin - end)).otherwise(c)


def with_fields(quads: DataFrame) -> DataFrame:
    """quads with entity id and field: one of the known fields, else the predicate and _t."""
    known = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    return quads.withColumn("id", F.concat_ws("|", "s", "source")).withColumn("field", F.coalesce(F.try_element_at(known, F.lower("p")), F.concat("p", F.lit("_t"))))


def runs(rows: DataFrame, key: str, order: list[str], within: list[str]) -> DataFrame:
    """rows with `run`: numbers of the runs of equal keys (case ignored) along the order, from 1 in each group of `within`."""
    along = Window.partitionBy(*within).orderBy(*order)
    changed = F.when(F.lower(key) != F.lag(F.lower(key)).over(along), 1).otherwise(0)
    return rows.withColumn("changed", changed).withColumn("run", (F.sum("changed").over(along.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("changed")


def assemble(quads: DataFrame, order: str = "line_no") -> DataFrame:
    """id, english, fields (map): repeated fields joined by blanks, newest first; english is that of the entity's last literal."""
    # one shuffle by entity serves both groupings
    facts = quads.select("id", "field", order, "o", F.when(F.col("literal"), F.struct(F.col(order).alias("at"), T.english_literal(F.col("o"), F.col("tag")).alias("english"))).alias("said")).repartition("id")
    value = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(order, "o")))), lambda x: x["o"]), " ")
    fields = facts.groupBy("id", "field").agg(value.alias("value"), F.max("said").alias("said"))
    return fields.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.coalesce(F.max("said")["english"], F.lit(True)).alias("english"))


def english_entities(entities: DataFrame) -> DataFrame:
    return entities.where("english").drop("english")


def wide(entities: DataFrame) -> DataFrame:
    """Known fields as columns, the rest as a map, with page and host."""
    known = sorted(set(FIELDS.values()))
    page = T.url_of_id(F.col("id"))
    return entities.select("id", page.alias("source_page"), T.host(page).alias("source_host"), *(F.try_element_at("fields", F.lit(f)).alias(f) for f in known), F.map_filter("fields", lambda k, _: ~k.isin(*known)).alias("props"))


def select_products(wide_rows: DataFrame, need: str = "name") -> DataFrame:
    """Products and offers that have what is needed: name, category, description, breadcrumb, or a kind alone."""
    typed = F.col("rdfs_type").isin("http://schema.org/Product", "http://schema.org/Offer")
    named = F.col("product_name").isNotNull() | F.col("offer_name").isNotNull()
    needs = {
        "name": named,
        "category": named & (F.col("product_category").isNotNull() | F.col("offer_category").isNotNull()),
        "description": named | F.col("product_description").isNotNull(),
        "breadcrumb": named & F.col("breadcrumb_title").isNotNull(),
        "product": F.col("product_name").isNotNull(),
        "offer": F.col("offer_name").isNotNull(),
    }
    return wide_rows.where(typed & needs[need])


def product_before_offer(field: str) -> Column:
    """The product's value of a field, or else the offer's."""
    return F.coalesce(f"product_{field}", f"offer_{field}")


def strip_name(category: Column, name: Column) -> Column:
    """The category without the name that it begins with; null if fewer than three characters are left."""
    rest = F.trim(F.when(category.startswith(name), F.substring(category, F.length(name) + 1, F.length(category))).otherwise(category))
    return F.when(F.length(rest) >= 3, rest)


def product_records(wide_rows: DataFrame, source: str = "", is_english: Callable[[Column], Column] | None = None) -> DataFrame:
    """Name, category and description of products, cleaned, the product's before the offer's; valid hosts and English descriptions only.

    is_english judges a description: english() as a default, better a fitted profile, languages.spoken().
    """
    rows = wide_rows.withColumn("name", T.clean_name(product_before_offer("name"))).where("name IS NOT NULL")
    rows = rows.withColumn("category", strip_name(T.clean_name_category(product_before_offer("category")), F.col("name")))
    raw = product_before_offer("description")
    rows = rows.withColumn("desc", T.clean_description(raw)).where(raw.isNull() | F.col("desc").isNull() | (is_english or english)(F.col("desc")))
    rows = rows.where(T.valid_host(F.col("source_host")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("id", "name", F.lit(source).alias("source_entity_index"), blank("category").alias("category"), blank("category").alias("category_str"), blank("desc").alias("desc"), blank("desc").alias("text"), F.col("source_host").alias("host"), F.col("source_page").alias("url"))


def english(c: Column) -> Column:
    """Enough of the words are common English ones: stands in for a language detector."""
    words = F.split(F.lower(c), "[^a-z']+")
    common = F.filter(words, lambda w: w.isin("the", "of", "and", "to", "in", "is", "for", "with", "a", "this", "that", "it", "on", "are", "be", "by", "or", "as", "you", "your", "from", "an", "at"))
    return F.size(common) >= F.size(words) * 0.1


def name_category_rows(wide_rows: DataFrame) -> DataFrame:
    """A row for the product and one for the offer, whose id ends in _sgoffer; an invalid product half hides the offer half."""

    fields = ("product_name", "product_category", "offer_name", "offer_category")
    wide_rows = wide_rows.select("id", "source_host", "source_page", *(F.col(c) for c in fields), *(T.clean_name_category(F.col(c)).alias(f"clean_{c}") for c in fields))
    pn, on = F.col("clean_product_name"), F.col("clean_offer_name")
    pc, oc = strip_name(F.col("clean_product_category"), pn), strip_name(F.col("clean_offer_category"), on)
    has = F.col("product_name").isNotNull() & F.col("product_category").isNotNull()
    product = F.when(has & pn.isNotNull() & pc.isNotNull(), F.struct(F.col("id"), pn.alias("name"), pc.alias("category"), F.col("source_page").alias("url")))
    offer = F.when((~has | product.isNotNull()) & on.isNotNull() & oc.isNotNull(), F.struct(F.concat("id", F.lit("_sgoffer")).alias("id"), on.alias("name"), oc.alias("category"), F.when(product.isNotNull(), F.col("source_page")).alias("url")))
    rows = wide_rows.select("source_host", F.explode(F.array_compact(F.array(product, offer))).alias("r"))
    return rows.select("r.id", "r.name", "r.category", F.col("r.category").alias("category_str"), F.col("source_host").alias("host"), "r.url")


def name_description_rows(wide_rows: DataFrame) -> DataFrame:
    """Names of two tokens at least with the product's description of ten characters and five tokens at least, in English."""
    name = T.ascii_only(T.basic_clean(F.coalesce("product_name", "offer_name", F.lit(""))))
    fine = ~F.lower(name).isin("product", "www") & (F.size(T.tokens(name)) >= 2) & ~name.startswith(".") & ~name.startswith("\\u")
    rows = wide_rows.withColumn("name", name).withColumn("desc", T.clean_description(F.col("product_description"), 10, 5)).where(fine & F.col("desc").isNotNull() & english(F.col("desc")))
    return rows.select("id", "name", F.col("desc").alias("text"))


def with_host(records: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Records with the host of their id's page that are large enough; only hosts of a list, if there is one."""
    rows = records.withColumn("host", T.host(T.url_of_id(F.col("id"))))
    rows = rows.where((F.col("name").isNull() | T.large_enough(F.col("name"), 10, 2)) & (F.col("text").isNull() | T.large_enough(F.col("text"), 20, 5)))
    return rows if hosts is None else rows.join(hosts, "host", "left_semi")


def merge_indices(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Descriptions with the categories of the same id, where there are any."""
    return left.join(right, key, "left")


def host_facet(rows: DataFrame, column: str = "host", least: int = 1, top: int | None = None, keep: Column | None = None) -> DataFrame:
    counted = (rows if keep is None else rows.where(keep)).groupBy(column).count().where(F.col("count") >= least)
    return counted if top is None else counted.orderBy(F.desc("count"), column).limit(top)


def flatten_list(c: Column) -> Column:
    """The values of a JSON list or object as text, split at commas."""
    return F.split(F.regexp_replace(c, r'[\[\]{}"]', ""), ",")


def offers_with_clusters(offers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Offers with the sizes of their clusters, null if unknown."""
    sizes = clusters.select(F.col("id").cast("string").alias("cluster_id"), F.col("size").alias("cluster_size"), "cluster_size_in_offers")
    return offers.join(sizes, "cluster_id", "left")


def id_host_counts(pairs: DataFrame) -> DataFrame:
    """How many ids there are, and how many on several hosts, of (product_id, host)."""
    per = pairs.groupBy("product_id").agg(F.count_distinct("host").alias("hosts"))
    return per.agg(F.count("*").alias("ids"), F.count_if(F.col("hosts") > 1).alias("shared_ids"))


def rejections(rows: DataFrame, column: str) -> DataFrame:
    plain = T.ascii_only(T.basic_clean(F.col(column)))
    reason = F.when(F.lower(plain).isin(*EMPTY_NAMES["product"]), "stop word").when(plain.startswith(".") | plain.startswith("\\u"), "unicode").when(F.length(plain) < 3, "short").when(~english(plain), "language").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).count()
