"""Readers of the product-data formats, each with a stated schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import placed

CLASSIFICATION = "ID string, Name string, Description string, CategoryText string, URL string, lvl1 string, lvl2 string, lvl3 string"
CLUSTERS = "id long, size long, cluster_size_in_offers long, id_values string, categoryDensity double, category string"
OFFERS = "id long, cluster_id string, identifiers string, category string, title string, description string, brand string, price string, specTableContent string, keyValuePairs string"
LABELLED = "cluster_id long, url string, categoryLabel string, `schema.org_properties` array<map<string,string>>, `parent_schema.org_properties` array<map<string,string>>"
CATALOGUE = "ID string, `Description.URL` string, Brand string, `SummaryDescription.LongSummaryDescription` string, Title string, `Category.CategoryID` string, `Category.Name.Value` string"
REVIEWS = "category string, rating double, text string, label string"


def quad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of text files, gz or not.

    Numbers within a file follow the order of the reader's partitions; a gz file is one partition, a plain file may be
    several, whose numbers follow their places in it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"), "value")
    return placed(lines, ["block", "seen"], ["file"]).select("file", (F.col("place") + 1).alias("line_no"), "value")


def line_range(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines from number start up to but without end."""
    return lines.where((F.col("line_no") >= start) & (F.col("line_no") < end))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).count()


def union_of(frames: dict[str, DataFrame], column: str = "source_entity_index") -> DataFrame:
    """All rows, with the name of the frame that they come from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(column, F.lit(name)) for name, df in frames.items()))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, sep: str = ";", quote: str = '"', header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("quote", quote).option("header", header).option("multiLine", quote != "")
    return (reader.schema(schema) if schema else reader).csv(path)


def titles_with_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title string, label string").option("sep", "\t").csv(path)


def _property(properties: Column, names: list[str], last: bool) -> Column:
    """The value of the last (or first) element that has one of the names, without its brackets."""
    hits = F.filter(properties, lambda m: F.exists(F.map_keys(m), lambda k: k.isin(*names)))
    hit = F.try_element_at(hits, F.lit(-1 if last else 1))
    value = F.coalesce(*(F.try_element_at(hit, F.lit(n)) for n in names))
    return F.nullif(F.regexp_replace(value, r"^\[|\]$", ""), F.lit(""))


def cluster_offers(rows: DataFrame) -> DataFrame:
    """Name, description, brand and manufacturer of labelled offers, from the offer's own properties or else its parent's."""
    own, parent = F.col("`schema.org_properties`"), F.col("`parent_schema.org_properties`")
    pick = lambda names, *more: F.coalesce(_property(own, names, True), *(_property(parent, n, False) for n in (names, *more)))
    return rows.select(
        F.col("cluster_id").alias("ID"),
        F.coalesce(pick(["/name"], ["/title"]), F.lit("")).alias("Name"),
        F.coalesce(pick(["/description"]), F.lit("")).alias("Desc"),
        F.coalesce(pick(["/brand"]), F.lit("")).alias("Brand"),
        F.coalesce(pick(["/manufacturer"]), F.lit("")).alias("Manufacturer"),
        F.col("url").alias("URL"),
        F.col("categoryLabel").alias("lvl1"),
    )


def offer_names(rows: DataFrame) -> DataFrame:
    """The first title or name of an offer."""
    return rows.select("cluster_id", _property(F.col("`schema.org_properties`"), ["/title", "/name"], False).alias("name"))


def train_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both, told apart by the column split."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def pair_sides(pairs: DataFrame) -> DataFrame:
    """label, left, right: the columns left_* and right_* joined by blanks."""
    side = lambda prefix: F.concat_ws(" ", *(F.col(c) for c in pairs.columns if c.startswith(prefix)))
    return pairs.select("label", side("left_").alias("left"), side("right_").alias("right"))


def tasks(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names without trailing dashes; no empty ones."""
    return names.select(F.trim(F.regexp_replace(F.trim(F.col(column)), "-+$", "")).alias(column)).where(F.col(column) != "").distinct()


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """freq, word of blank-separated lines."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.try_element_at("p", F.lit(1)).try_cast("long").alias("freq"), F.try_element_at("p", F.lit(2)).alias("word")).where("word IS NOT NULL")


def frequency_bounds(counts: DataFrame) -> DataFrame:
    """least, total: the smallest count of a list of frequencies and the sum of all."""
    return counts.agg(F.min("freq").alias("least"), F.sum("freq").alias("total"))


def corpus_words(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, words of text files: lower-case tokens of each line that has any."""
    rows = quad_lines(spark, path).select("file", "line_no", F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != "").alias("words"))
    return rows.where(F.size("words") > 0)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """word, vector of a text file with a word and its numbers per line; a head line of two numbers is left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    return parts.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vector"))


def dictionaries(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    """label, pos, word, score from files named <label>_<pos>.csv: the first rows of each by rank."""
    frame = spark.read.schema("word string, score double").csv(folder).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= rows)
    return ranked.select(F.regexp_extract("file", "^(.*)_([^_]+)$", 1).alias("label"), F.regexp_extract("file", "^(.*)_([^_]+)$", 2).alias("pos"), "word", "score")


def settings(text: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """key=value lines without comments and outer quotes; overrides win."""
    pairs = (line.partition("=") for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip('"') for k, _, v in pairs} | (overrides or {})
