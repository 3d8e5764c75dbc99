"""Line deduplication by a log-template tree of fixed depth.

A line's tokens with digits are masked; its leaf in the tree is its number of tokens and its leading tokens. Going through
the lines of a leaf in the order of their first documents, a line that agrees with no template so far becomes a
template, and one that agrees in enough positions joins the first template that it agrees with, whose other positions
are variable. Joining lines are measured by the template's own line, so every line that goes has a line that stays and agrees
with it. A line of a template that recurs in several documents stays in the template's first document and is dropped
from the others. Every line goes through the tree, however short, and no line of a leaf is left out, however many
templates the leaf holds.

Texts are read three times, by Arrow batches: for the keys and leaves of all lines, for the words of the lines of leaves
that hold several different ones, and to write the texts that lose lines. Only keys are grouped, with partial sums, so
a line that is in a third of all documents is no burden. The lines of a leaf go through one task if they are few
(MOST_LINES). In a larger leaf those that agree with its first line are settled by a join. Of the others, those without an
earlier line that agrees are templates, and those that agree with one of these belong to it; what is left, lines whose
earlier lines all belong elsewhere, goes through the same again. Lines that may agree are found by blocks of positions, one
block more than positions may differ, so that they have a block in common; a block's lines are compared in bounded chunks.
The result is the same each way. Keys are hashes of 128 bits, compared words hashes of 64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from millrace.llm.shared import discard, new_names, pieces, written

#: Different lines of a leaf, or of a block of positions, that one task compares; fewer where they have many words in all.
MOST_LINES, MOST_WORDS = 1000, 4_000_000

_DIGIT = re.compile("[0-9]").search
_FIELD = re.compile(r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*")


def masked(line: str) -> str:
    """The line's tokens, as str.split cuts them, joined by blanks; a token with a digit is <*>."""
    even = " ".join(line.split())
    return _FIELD.sub("<*>", even) if _DIGIT(even) else even


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _leaf(line: str, n: int, depth: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{n} {' '.join(line.split(' ', depth)[:depth])}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _variable(n, similarity: float):
    """How many of n positions may differ, as a number or a column."""
    most = n * (1 - similarity) + 1e-9
    return F.floor(most).cast("int") if isinstance(n, Column) else int(most)


def _lines(depth: int, least: int):
    """doc_id, key, leaf, n (tokens) of each text's different masked lines with `least` tokens; blank lines are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, keys, leaves, sizes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for line in dict.fromkeys(map(masked, text.split("\n"))):
                    n = line.count(" ") + 1
                    if line and n >= least:
                        row.append(i)
                        keys.append(line_key(line))
                        leaves.append(_leaf(line, n, depth))
                        sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(keys, pa.binary()), pa.array(leaves, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "key", "leaf", "n"])

    return run, "key binary, leaf long, n int"


def _words(schema: pa.Schema, depth: int):
    """group (the leaf), key, n, ids, lines, words (hashes) of the lines in column `wanted`, from the texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                known = {w["key"]: (w["ids"], w["lines"]) for w in wanted}
                for line in dict.fromkeys(map(masked, text.split("\n"))):
                    if (key := line_key(line)) in known:
                        words = line.split(" ")
                        out.append((_leaf(line, len(words), depth), key, len(words), *known[key], [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in words]))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


#: What is found of a line: the first line `by`, in documents `ids`, that it agrees with.
FOUND = "key binary, by binary"


def _agreeing(similarity: float, grow: bool, schema: pa.Schema):
    """For rows in the order of group, part, low, key: the first earlier line of its group and part that each agrees with.

    Role 0 is compared with, role 1 looks for lines, role 2 does both; with `grow` a line that has found one is no longer compared
    with, as only templates are. The lines of one group have the same number of words.
    """

    def found(rows: pa.Table) -> list[tuple[bytes, bytes, list]]:
        ids, keys, role = rows["ids"].to_pylist(), rows["key"].to_pylist(), rows["role"].to_numpy()
        words = rows["words"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        least = words.shape[1] - _variable(words.shape[1], similarity)
        left, out, owned = np.flatnonzero(role > 0), [], np.zeros(rows.num_rows, bool)
        for s in np.flatnonzero(role != 1).tolist():
            if not len(left):
                break
            if grow and owned[s]:
                continue
            left = left[left > s] if role[s] == 2 else left
            same = (words[left] == words[s]).sum(1) >= least
            mine = [t for t in left[same].tolist() if (ids[s][0], keys[s]) < (ids[t][0], keys[t])]
            if mine:
                out += [(keys[t], keys[s], ids[s]) for t in mine]
                owned[mine] = True
                left = left[~owned[left]]
        return out

    def packed(rows: list[tuple[bytes, bytes, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.binary()), pa.array([b for _, b, _ in rows], pa.binary()), pa.array([d for _, _, d in rows], schema.field("ids").type)], names=["key", "by", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, rows = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("group", "part")])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(at[:, begin].tolist())
                if held and now != last:
                    rows += found(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(begin, end - begin))
            if len(rows) > 5000:
                yield packed(rows)
                rows = []
        if held:
            yield packed(rows + found(pa.Table.from_batches(held)))

    return run


def _settled(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (group, key, n, ids, words) with `first`, the group's first line, and `agrees`, whether they agree with it (but are not it)."""
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("ids")[0].alias("low"), "key", "ids", "words")).alias("first")).withColumnRenamed("group", "of")
    both = rows.join(first, F.col("group") == F.col("of")).drop("of")
    same = F.size(F.filter(F.zip_with("words", "first.words", lambda a, b: a == b), lambda x: x))
    return both.withColumn("agrees", (same >= F.col("n") - _variable(F.col("n"), similarity)) & (F.col("key") != F.col("first.key")))


class _Leaves:
    """Comparison of the lines of leaves with more than one."""

    def __init__(self, rows: DataFrame, depth: int, similarity: float, arrow: pa.Schema) -> None:
        self.depth, self.similarity, self.arrow = depth, similarity, arrow
        self.found = StructType([*StructType.fromDDL(FOUND), rows.schema["ids"]])
        # lines of one group have the same number of words
        self.most = F.greatest(F.lit(2), F.least(F.lit(MOST_LINES), F.floor(F.lit(MOST_WORDS) / F.col("n"))))

    def first(self, dealt: DataFrame, grow: bool = False) -> DataFrame:
        dealt = dealt.select("group", "part", "role", "key", "ids", "words").repartition("group", "part").sortWithinPartitions("group", "part", F.col("ids")[0], "key")
        return dealt.mapInArrow(_agreeing(self.similarity, grow, self.arrow), self.found)

    def whole(self, rows: DataFrame) -> DataFrame:
        """The templates of lines that are not templates themselves, of leaves that a task holds whole."""
        return self.first(rows.withColumns({"part": F.lit(0), "role": F.lit(2)}), grow=True)

    def matched(self, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The first line with role 0 or 2, of any block, that each line with role 1 or 2 agrees with; and tables to discard then."""
        rest, d = F.col("n") - self.depth, _variable(F.col("n"), self.similarity)
        cut = rows.withColumn("blocks", F.least(d + 1, rest)).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        begin = lambda b: F.floor(b * rest / F.col("blocks")).cast("int")
        # where all positions may differ, the leaf is one block
        block = F.when(d < rest, F.slice("words", begin(F.col("block")) + self.depth + 1, begin(F.col("block") + 1) - begin(F.col("block"))))
        blocks = cut.select(F.xxhash64("group", "block", block).alias("group"), "key", "n", "ids", "words", "role")
        counts = blocks.groupBy("group").agg(F.count("*").alias("lines"), F.count_if(F.col("role") != 1).alias("sources"), F.count_if(F.col("role") > 0).alias("seekers")).where("lines > 1 AND sources > 0 AND seekers > 0")
        blocks = written(blocks.join(counts.withColumnRenamed("group", "of"), F.col("group") == F.col("of")).drop("of"), "blocks")
        small = blocks.where(F.col("lines") <= self.most).withColumn("part", F.lit(0))
        # in a large block, lines that agree with its first have found one
        large = written(_settled(blocks.where(F.col("lines") > self.most), self.similarity).withColumns({"done": F.col("agrees") & (F.col("role") == 2), "parts": F.ceil(F.col("sources") / self.most).cast("int")}), "large")
        done = large.where("done").select("key", F.col("first.key").alias("by"), F.col("first.ids").alias("ids"))
        sources = large.where("role <> 1").withColumns({"part": F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), "role": F.lit(0)})
        seekers = large.where("role > 0 AND NOT done").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(1)})
        columns = ["group", "part", "role", "key", "ids", "words"]
        dealt = small.select(columns).unionByName(sources.select(columns)).unionByName(seekers.select(columns))
        return self.one(self.first(dealt).unionByName(done)), [blocks, large]

    def one(self, found: DataFrame) -> DataFrame:
        best = found.groupBy("key").agg(F.min(F.struct(F.col("ids")[0].alias("low"), "by", "ids")).alias("best"))
        return best.select("key", "best.by", "best.ids")


def _templates(rows: DataFrame, leaves: _Leaves) -> DataFrame:
    """key, by (the template's line), ids (its documents) of the lines `rows` (group, key, n, ids, lines, words) that join a template."""
    columns = ["group", "key", "n", "ids", "words"]
    answers = [written(leaves.whole(rows.where(F.col("lines") <= leaves.most)), "whole")]
    settled = written(_settled(rows.where(F.col("lines") > leaves.most).select(columns), leaves.similarity), "settled")
    answers.append(settled.where("agrees").select("key", F.col("first.key").alias("by"), F.col("first.ids").alias("ids")))
    left = settled.where((F.col("key") != F.col("first.key")) & ~F.col("agrees")).select(columns)
    lines = left.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("lines"))
    left = left.join(lines, F.col("group") == F.col("of")).drop("of")
    answers.append(written(leaves.whole(left.where(F.col("lines") <= leaves.most)), "whole"))
    large = written(left.where(F.col("lines") > leaves.most).select(columns), "large")
    left, owned, stale = large, [], []
    while not left.isEmpty():
        earlier, used = leaves.matched(left.withColumn("role", F.lit(2)))
        has = earlier.select(F.col("key").alias("found"))
        marked = written(left.join(has, F.col("key") == F.col("found"), "left").withColumn("role", F.when(F.col("found").isNull(), 0).otherwise(1)).drop("found"), "marked")
        discard(*used)
        now, used = leaves.matched(marked)
        owned.append(written(now, "owned"))
        discard(*used)
        stale.append(marked)
        left = marked.where("role = 1").select(columns).join(owned[-1].select("key"), "key", "left_anti").select(columns)
    if len(owned) > 1:  # a template of a later time may be an earlier line than the one that a line has joined
        joined = owned[0].select("key")
        for more in owned[1:]:
            joined = joined.unionByName(more.select("key"))
        joined = joined.withColumnRenamed("key", "found")
        now, used = leaves.matched(large.join(joined, F.col("key") == F.col("found"), "left").withColumn("role", F.when(F.col("found").isNull(), 0).otherwise(1)).drop("found"))
        stale += owned
        owned = [written(now, "owned")]
        discard(*used)
    answers += owned
    known = answers[0]
    for more in answers[1:]:
        known = known.unionByName(more)
    known = written(known, "templates")
    discard(settled, large, *stale, *(a for a in answers if hasattr(a, "written_to")))
    return known


def recurring(docs: DataFrame, lines: DataFrame, depth: int = 3, similarity: float = 0.8, min_docs: int = 2) -> DataFrame:
    """key, owner (the first document of its template) of the lines whose template is in min_docs documents of (doc_id, text); `lines` has doc_id, key, leaf, n."""
    if min_docs > 2:  # the first min_docs documents of a line tell as much as all
        ranked = lines.distinct().withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where(F.col("at") <= min_docs)
        each = ranked.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    else:
        each = lines.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        each = each.select("key", "leaf", "n", F.array_distinct(F.array("low", "high")).alias("ids"))
    each = written(each, "each")
    varied = each.where((_variable(F.col("n"), similarity) > 0) & (F.col("n") > depth))
    leaves = varied.groupBy("leaf").agg(F.count("*").alias("lines"), F.min(F.col("ids")[0]).alias("a"), F.max(F.element_at("ids", -1)).alias("b")).where("lines > 1 AND a <> b")
    leaves = leaves.select((F.col("leaf") + 0).alias("of"), "lines")
    wanted = varied.join(leaves.hint("shuffle_hash"), F.col("leaf") == F.col("of"))
    wanted = wanted.groupBy(F.col("ids")[0].alias("__low")).agg(F.collect_list(F.struct("key", "ids", "lines")).alias("wanted"))
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("__low")).select("text", "wanted")
    schema = StructType.fromDDL("group long, key binary, n int").add("ids", each.schema["ids"].dataType).add("lines", "long").add("words", ArrayType(LongType()))
    arrow = lines.sparkSession.createDataFrame([], schema).toArrow().schema
    rows = written(texts.mapInArrow(_words(arrow, depth), schema).dropDuplicates(["key"]), "words")
    joined = _templates(rows, _Leaves(rows, depth, similarity, arrow))

    if min_docs <= 2:  # a line's own documents and those of its template's line
        found = each.select("key", "ids").unionByName(joined.select("key", "ids")).select("key", F.explode("ids").alias("id"))
        known = found.groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("high")).where("true" if min_docs < 2 else "owner <> high").select("key", "owner")
    else:  # all documents of the template
        members = each.select("key", "ids").join(joined.select(F.col("key").alias("k"), "by"), F.col("key") == F.col("k"), "left").select("key", F.coalesce("by", "key").alias("template"), "ids")
        few = members.select("template", F.explode("ids").alias("id")).distinct().groupBy(F.col("template").alias("of")).agg(F.count("*").alias("docs"), F.min("id").alias("owner")).where(F.col("docs") >= min_docs)
        known = members.join(few, F.col("template") == F.col("of")).select("key", "owner")
    known = written(known, "recurring")
    discard(each, rows, joined)
    return known


def _without(schema: pa.Schema, text_col: str):
    """The rows, texts without the lines whose keys are in the last column; the number of dropped lines in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.get_field_index(text_col)
        for batch in pieces(batches, text_col):
            texts, dropped = batch.column(text_col).to_pylist(), [0] * batch.num_rows
            for i, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if gone and texts[i]:
                    gone, lines = set(gone), texts[i].split("\n")
                    kept = [line for line in lines if line_key(masked(line)) not in gone]
                    texts[i], dropped[i] = "\n".join(kept), len(lines) - len(kept)
            columns = [*batch.columns[:-1], pa.array(dropped, pa.int64())]
            columns[at] = pa.array(texts, schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.8, min_docs: int = 2, min_tokens: int = 1, count_col: str = "dropped_lines") -> DataFrame:
    """docs with all its columns, its text without the lines whose template other documents had first, and their number in count_col (long).

    A document is an id: rows that repeat an id own lines together, and a row without an id owns none and loses none.
    Blank lines and lines of fewer than min_tokens tokens always stay; lines too short for a variable position recur when
    equal after masking. Null text stays null and empty text empty; a text may lose all its lines and is then empty.
    A text is held whole by the task that reads it. A column named count_col is replaced. No rows in, no rows out.
    """
    docs = docs.drop(count_col)
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    run, schema = _lines(depth, min_tokens)
    lines = written(mine.mapInArrow(run, StructType([mine.schema["doc_id"], *StructType.fromDDL(schema)])), "lines")
    known = recurring(mine, lines, depth, similarity, min_docs).withColumnRenamed("key", "k")
    gone = lines.join(known, (F.col("key") == F.col("k")) & (F.col("doc_id") != F.col("owner")))
    here, gone_col = new_names(docs, "id", "gone")
    gone = gone.groupBy(F.col("doc_id").alias(here)).agg(F.collect_set("key").alias(gone_col))
    joined = docs.join(gone.hint("shuffle_hash"), F.col(f"`{id_col}`") == F.col(here), "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone_col)
    out = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{count_col}` long")])
    arrow = docs.sparkSession.createDataFrame([], out).toArrow().schema
    return joined.mapInArrow(_without(arrow, text_col), out)
