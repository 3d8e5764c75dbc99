"""N-gram Jaccard self-join by grouped prefixes.

A document's set is its distinct word n-grams as 64-bit hashes. Equal sets are one class from the start. Two sets that
are similar enough share an element of their prefixes, the first elements in an order common to all sets. The order puts
the elements with the lowest hashes first, a window somewhat larger than a prefix, those in fewest sets before others,
and the rest after them by hash. So only the window's elements have to be counted, over all documents, and a passage found everywhere
brings no strangers together: elements of one set only come first, and a set with enough of those has no partner.

Classes with identical prefixes and size form a group. Groups that share a prefix element and whose sizes are close
enough are filtered by sketches: bit i of a sketch is the parity of the elements that fall to it, so two sets differ in
as many elements at least as their sketches in bits. What passes links groups to candidate components. Where an element
has more groups than a task compares with one, or sets are too large for short sketches, groups are chained instead and
the chains filtered in blocks by longer sketches. Candidate components are expanded to their members, whose whole sets are
compared. The members of a large component are first compared with its commonest; only those that do not link with it
are compared with all others, in blocks of bounded size. Each task gives its links as a forest, one link a member at
most: no pair of documents is emitted, and every link holds its ends in one component.

Shingles and classes are told apart by hashes of 64 bits, which are not compared with the words again: among a billion
different texts two share a class by mistake with a chance of 3 in 100.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.connected import components, unite
from millrace.llm.shared import discard, new_names, pieces, written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of texts that are hashed at a time; a longer text is by itself and needs some 50 bytes for each of its own.
SLICE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))


_kept_powers = lru_cache(1)(lambda: _powers(SLICE + 2))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's n-grams: ASCII lower-cased, words between ASCII blanks; a shorter text is one n-gram, one without words has none."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    n = len(raw) + 1
    power, inverse = (x[:n] for x in _kept_powers()) if n <= SLICE + 2 else _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    word = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum([len(c) + 1 for c in coded])
    upto = np.concatenate([[0], np.searchsorted(begin, ends)])
    gram = word
    for i in range(1, words):
        gram = _mix(gram[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[i:]) if len(gram) > 1 else gram[:0]
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            short = int.from_bytes(hashlib.blake2b(word[a:b].tobytes(), digest_size=8, salt=b"short").digest(), "little")
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


#: Words of 64 bits in a short sketch; sets above LONG elements also have a sketch of LONG_BITS.
SHORT, LONG, LONG_BITS = 8, 1500, 8192
SKETCH = [f"s{i}" for i in range(SHORT)]


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the elements by their low bits, as words of 64 bits."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_different(n, m, percent: int):
    """The most elements that are in only one of two sets of n and m elements which link."""
    return n + m + 2 * (-percent * (n + m) // (100 + percent))


def _windows(words: int, percent: int, window: float):
    """Per row: fingerprint of the set, its size, its elements in the window, and what its prefix needs beyond them."""
    below = np.uint64(int(window * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
        for batch in pieces(batches, "text", SLICE):
            prints, sizes, lows, tails, short, long = [], [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                w = int(np.searchsorted(s, below))
                prints.append(class_of(s))
                sizes.append(len(s))
                lows.append(s[:w].view(np.int64))
                tails.append(s[w : max(w, prefix_length(len(s), percent))].view(np.int64))
                short.append(sketch(s, 64 * SHORT))
                long.append(sketch(s, LONG_BITS).tobytes() if len(s) > LONG else None)
            parts = [pa.array(c) for c in np.array(short, np.int64).reshape(-1, SHORT).T.copy()]
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(x) for x in lows], pa.int64()), listed(lows), listed(tails), *parts, pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "class", "n", "w", "low_elements", "tail", *SKETCH, "long"])

    return run, "doc_id long, mark long, class long, n long, w long, low_elements array<long>, tail array<long>, " + ", ".join(f"{c} long" for c in SKETCH) + ", long binary"


def _close(percent: int, reach: int, rows: int = 1 << 17):
    """Links of groups from rows sorted by element, size and group: each row with those after it, by sketch and size, as a forest.

    Pairs of long sets, and rows with more than `reach` others after them in a size that can link, are chained, as loose links.
    """
    names = ["element", "n", "group", "radius", *SKETCH]

    def block(c: np.ndarray, old: int) -> Iterator[pa.RecordBatch]:
        """c holds a column per name; of the first `old` rows, pairs among themselves are known."""
        element, n, radius, sk = c[0], c[1], c[3], c[4:].T.copy().view(np.uint64)
        names_of, group = np.unique(c[2], return_inverse=True)
        firm, loose = np.arange(len(names_of)), np.arange(len(names_of))
        active = np.arange(len(n))
        for d in range(1, reach + 1):
            active = active[active + d < len(n)]
            ok = (element[active] == element[active + d]) & (n[active + d] * percent <= n[active] * 100)
            active = active[ok]
            if not len(active):
                break
            a = active[active + d >= old]
            a = a[firm[group[a]] != firm[group[a + d]]]
            b, both = a + d, n[a] > LONG
            hit = np.bitwise_count(sk[a] ^ sk[b]).sum(1, dtype=np.int64) <= most_different(n[a], n[b], percent) + radius[a] + radius[b]
            unite(firm, group[a[hit & ~both]], group[b[hit & ~both]])
            unite(loose, group[a[hit & both]], group[b[hit & both]])
        # rows that reach further: all neighbours within what they reach form a chain
        last = np.full(len(n), -1)
        last[active] = active
        last = np.maximum.accumulate(last)[:-1]
        at = np.arange(len(n) - 1)
        chain = (last >= 0) & (element[last] == element[1:]) & (n[1:] * percent <= n[last] * 100) & (at + 1 - last <= reach)
        unite(loose, group[at[chain]], group[at[chain] + 1])
        for label, kind in ((firm, False), (loose, True)):
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(names_of[label[moved]]), pa.array(names_of[moved]), pa.array(np.full(len(moved), kind))], names=["a", "b", "loose"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, old = [], 0, 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]))
            waiting += batch.num_rows
            if waiting >= rows:
                whole = np.concatenate(held, 1)
                yield from block(whole, old)
                held, waiting, old = [whole[:, -reach:]], 0, min(reach, whole.shape[1])
        if waiting:
            yield from block(np.concatenate(held, 1), old)

    return run, "a long, b long, loose boolean"


def _long(column) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a long sketch, and the sketches, a row for each of the rows."""
    has = np.array([x is not None for x in column], bool)
    long = np.zeros((len(has), LONG_BITS // 64), np.uint64)
    if has.any():
        long[has] = np.frombuffer(b"".join(x for x in column if x is not None), np.uint64).reshape(-1, LONG_BITS // 64)
    return has, long


def _may_link(percent: int, n, radius, short, has, long, m, radius2, short2, has2, long2) -> np.ndarray:
    """Whether sizes and sketches of groups allow links with those of others."""
    most = most_different(n, m, percent) + radius + radius2
    ok = (n * percent <= m * 100) & (m * percent <= n * 100) & (np.bitwise_count(short ^ short2).sum(-1, dtype=np.int64) <= most)
    both = ok & has & has2
    if both.any():
        pick = lambda x: x[both] if x.ndim > 1 else x
        ok[both] = np.bitwise_count(pick(long) ^ pick(long2)).sum(-1, dtype=np.int64) <= most[both]
    return ok


def _near_first(percent: int):
    """Whether each group may link with its part's `rep`, whose columns end in 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                number = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
                short = lambda end: np.stack([number(c + end) for c in SKETCH], 1).view(np.uint64)
                sides = [(number("n" + e), number("radius" + e), short(e), *_long(batch.column("long" + e).to_pylist())) for e in ("", "2")]
                like = _may_link(percent, *sides[0], *sides[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "part", "rep")), pa.array(like)], names=["group", "part", "rep", "like"])

    return run, "group long, part long, rep long, like boolean"


def _near(percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Groups of side 0 with those of side 1 (2 is both): a forest over the pairs that sizes and sketches allow."""
        frame = frame.sort_values("n", kind="stable")
        names, at = np.unique(frame["group"].to_numpy(), return_inverse=True)
        n, radius, side = (frame[c].to_numpy() for c in ("n", "radius", "side"))
        short = np.ascontiguousarray(frame[SKETCH].to_numpy(np.int64)).view(np.uint64)
        has, long = _long(frame["long"])
        label, right = np.arange(len(names)), np.flatnonzero(side != 0)
        for i in np.flatnonzero(side != 1):
            j = right[np.searchsorted(n[right], -(-n[i] * percent // 100)) : np.searchsorted(n[right], n[i] * 100 // percent, side="right")]
            j = j[label[at[j]] != label[at[i]]]
            j = j[_may_link(percent, n[j], radius[j], short[j], has[j], long[j], n[i], radius[i], short[i], has[i], long[i])]
            unite(label, np.full(len(j), at[i]), at[j])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})

    return run, "a long, b long"


def _dealt(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """rows (part, blocks, key, ...) to be compared, with one, two and side.

    Parts of one block are whole (side 2). Of larger ones those that seen says are not like the first, side 0, meet all
    members, side 1, in blocks, each pair of blocks by itself; both sides have blocks of about the same size.
    """
    columns = [c for c in rows.columns if c not in ("blocks", "members", "rep")]
    small = rows.where("blocks = 1").select(*columns, F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(2).alias("side"))
    rest = seen.where("NOT like").select((F.col(key) + 0).alias("c"), F.col("part").alias("q")).distinct()
    counts = rest.groupBy("q").agg(F.count("*").alias("rest")).withColumnRenamed("q", "p")
    parts = rows.where("blocks > 1").join(counts, F.col("part") == F.col("p"))
    parts = parts.withColumn("left", F.ceil(F.col("rest") * F.col("blocks") / F.col("members")).cast("int"))
    place = lambda of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    seekers = parts.join(rest, (F.col(key) == F.col("c")) & (F.col("part") == F.col("q"))).select(*columns, place("left").alias("one"), upto("blocks").alias("two"), F.lit(0).alias("side"))
    others = parts.select(*columns, upto("left").alias("one"), place("blocks").alias("two"), F.lit(1).alias("side"))
    return small.unionByName(seekers).unionByName(others)


def _candidates(groups: DataFrame, percent: int, reach: int, block_groups: int) -> DataFrame:
    """group, root of the groups (group, n, prefix, radius, sketches) that may link with another."""
    listed = groups.select("group", "n", "radius", *SKETCH, F.explode("prefix").alias("element"))
    run, schema = _close(percent, reach)
    close = written(listed.repartition("element").sortWithinPartitions("element", "n", "group").mapInArrow(run, schema), "close")
    firm = close.where("NOT loose").select("a", "b")
    chains = components(close.where("loose").select("a", "b"))
    loose = groups.select("group", "n", "radius", "copies", "long", *SKETCH).join(chains, F.col("group") == F.col("node")).withColumnRenamed("root", "part")
    sizes = loose.groupBy("part").agg(F.count("*").alias("members"), F.ceil(F.count("*") / block_groups).cast("int").alias("blocks"), F.max(F.struct("copies", "group"))["group"].alias("rep")).withColumnRenamed("part", "p")
    loose = written(loose.drop("node", "copies").join(sizes, F.col("part") == F.col("p")).drop("p"), "loose")
    # as with whole sets: a large chain's groups first with its commonest, what is left with all
    large = loose.where("blocks > 1")
    first = large.where("group = rep").select((F.col("part") + 0).alias("p"), *(F.col(c).alias(f"{c}2") for c in ("n", "radius", "long", *SKETCH)))
    compare, columns = _near_first(percent)
    seen = written(large.join(first, F.col("part") == F.col("p")).mapInArrow(compare, columns), "near_first")
    run, schema = _near(percent)
    near = _dealt(loose, seen, "group").groupBy("part", "one", "two").applyInPandas(run, schema)
    label = components(firm.unionByName(near).unionByName(seen.where("like").select(F.col("group").alias("a"), F.col("rep").alias("b"))))
    discard(close, chains, loose, seen)
    return label


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            mine = [class_of(s) == c for s, c in zip(sets, batch.column("class").to_pylist(), strict=True)]
            rest = ["class", "part", "members", "blocks", "rep"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*rest, "elements"]).filter(pa.array(mine))

    return run, "class long, part long, members long, blocks int, rep long, elements binary"


def _like_first(percent: int):
    """Whether each row's elements link with its `first` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "elements", 4 << 20):
            like = []
            for x, y in zip(batch.column("elements"), batch.column("first"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                like.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "part", "rep")), pa.array(like, pa.bool_())], names=["class", "part", "rep", "like"])

    return run, "class long, part long, rep long, like boolean"


def _linked(percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Compares the members of side 0 with those of side 1 (2 is both): a forest over the links."""
        frame = frame.sort_values("side", kind="stable").drop_duplicates(["class", "side"])
        names, at = np.unique(frame["class"].to_numpy(), return_inverse=True)
        side = frame["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        sets = [np.frombuffer(e, np.uint64) for e in frame["elements"]]
        size = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[column] > 1  # an element of one member is common to none
        row, column = row[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, [c, c + 4096])
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[row[a:b], column[a:b] - c] = 1
            common += dense[left] @ dense[right].T
        link = 100 * common.astype(np.int64) >= percent * (size[left][:, None] + size[right][None, :] - common.astype(np.int64))
        i, j = np.nonzero(link)
        label = np.arange(len(names))
        unite(label, at[left[i]], at[right[j]])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})

    return run, "a long, b long"


def _links(wanted: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of the classes of wanted (class, low, part, members, blocks, rep), enough for their components.

    Components of one block are a task each. Of larger ones, members that link with `rep` are linked by that, and the
    others are compared with all in blocks.
    """
    run, schema = _whole_sets(words)
    # texts are dealt by id whether few of them are wanted or many: no list of documents goes to every task
    whole = rows.join(wanted.hint("shuffle_hash"), F.col("low") == F.col("doc_id")).select("class", "part", "members", "blocks", "rep", "text").mapInArrow(run, schema)
    whole = written(whole, "whole")
    large = whole.where("blocks > 1")
    first = large.where("class = rep").dropDuplicates(["part"]).select((F.col("part") + 0).alias("p"), F.col("elements").alias("first"))
    compare, columns = _like_first(percent)
    seen = written(large.join(first, F.col("part") == F.col("p")).select("class", "part", "rep", "elements", "first").mapInArrow(compare, columns), "like_first")
    run, schema = _linked(percent)
    found = _dealt(whole, seen, "class").groupBy("part", "one", "two").applyInPandas(run, schema)
    links = written(found.unionByName(seen.where("like").select(F.col("class").alias("a"), F.col("rep").alias("b"))), "links")
    discard(whole, seen)
    return links


def _components(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", window: float = 1.3, block_members: int = 500, block_elements: int = 500_000, block_groups: int = 8000, reach: int = 512) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id of every row; window, block_* and reach deal the work and change no result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    run, schema = _windows(words, percent, min(1.0, window * (100 - percent) / 100))
    sets = written(rows.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()), "sets")
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"), F.min("at").alias("first"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    single = written(sets.join(classes.select("first"), F.col("at") == F.col("first")).drop("doc_id", "mark", "at", "first"), "single")
    elements = single.select("class", F.explode("low_elements").alias("element"))
    often = elements.groupBy("element").agg(F.count("*").alias("sets")).where("sets > 1")
    # another expression than the grouping's, so that the join has its own exchange, which Spark can split where it is hot
    often = often.select((F.col("element") + 0).alias("e"), "sets")
    shared = elements.join(often, F.col("element") == F.col("e")).groupBy("class").agg(F.collect_list(F.struct("sets", "element")).alias("shared"))
    known = single.join(shared.withColumnRenamed("class", "of"), F.col("class") == F.col("of"), "left")
    known = known.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<sets:bigint,element:bigint>>")))
    # elements in no other set fill the prefix first; as nobody shares them they need not be listed
    alone = (F.col("w") - F.size("shared")).cast("int")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    picked = F.slice(F.sort_array("shared"), F.lit(1), F.greatest(F.lit(0), length - F.size("tail") - alone))
    known = known.select("class", "n", "long", *SKETCH, F.concat(F.transform(picked, lambda x: x["element"]), "tail").alias("prefix"), F.when(alone > 0, F.col("class")).alias("unlike")).where(F.size("prefix") > 0)
    # two hashes of 64 bits name a prefix and a size
    classes_now = written(known.select("*", F.xxhash64("prefix", "n", "unlike").alias("g"), F.xxhash64("unlike", "n", "prefix").alias("h")), "prefixes")
    # a group's sketch has the bits that all its members have; from it to a member's own it is `radius` bits at most
    radius = sum((F.bit_count(F.bit_or(c).bitwiseXOR(F.bit_and(c))) for c in SKETCH), F.lit(0)).cast("long")
    common = [F.bit_and(c).alias(c) for c in SKETCH]
    groups = classes_now.groupBy("g", "h").agg(F.min("class").alias("group"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), radius.alias("radius"), F.when(F.count("*") == 1, F.first("long")).alias("long"), F.count("*").alias("copies"), *common)
    groups = written(groups, "groups")
    label = _candidates(groups, percent, reach, block_groups)

    parts = groups.join(label, F.col("group") == F.col("node"), "left").select(F.col("g").alias("g2"), F.col("h").alias("h2"), F.coalesce("root", "group").alias("part"))
    members = classes_now.select("class", "n", "g", "h").join(parts, (F.col("g") == F.col("g2")) & (F.col("h") == F.col("h2")))
    members = members.select("part", "n", F.col("class").alias("c")).join(classes, F.col("class") == F.col("c"))
    members = written(members.select("part", "n", "class", "low", "copies"), "members")
    sizes = members.groupBy("part").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.max(F.struct("copies", "class"))["class"].alias("rep")).where("members > 1")
    # a block has block_members members and block_elements elements, about; at least one member
    blocks = F.greatest(F.ceil(F.col("members") / block_members), F.ceil(F.col("elements") / block_elements))
    sizes = sizes.select((F.col("part") + 0).alias("p"), "members", F.least(blocks, "members").cast("int").alias("blocks"), "rep")
    wanted = written(members.join(sizes, F.col("part") == F.col("p")).drop("p", "n", "copies"), "wanted")
    links = _links(wanted, rows, words, percent)
    discard(label)
    label = components(links)
    # the smallest id of each component, for its classes
    linked = label.join(classes, F.col("class") == F.col("node")).select("root", "class", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("least")).withColumnRenamed("root", "r")
    lowest = linked.join(lowest, F.col("root") == F.col("r")).select(F.col("class").alias("of"), "least")
    found = written(classes.select("class", "low").join(lowest, F.col("class") == F.col("of"), "left").select(F.col("class").alias("c"), F.coalesce("least", "low").alias("least")), "found")
    discard(label, classes, single, classes_now, groups, members, wanted, links)
    out = sets.select("doc_id", "mark", "n", "class").join(found, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Rows link when 100 * intersection >= percent * union of their sets of `words`-word n-grams (3 and 90 by default). component_id is the
    smallest id that links reach. Null and blank texts have an empty set and are linked with nothing. Equal sets are one
    class, whatever their ids; a repeated id with other texts has each text's own class and links. Rows without an id
    get no component and are no bridge. No rows in, no rows out; other columns are not looked at. The options
    are those of _components.
    """
    return _components(docs, **options).drop("mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with all its columns, but of each component only the rows with its smallest id; rows without an id stay."""
    gone = _components(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <> component_id")
    here, mark = new_names(docs, "id", "mark")
    gone = gone.select(F.col("doc_id").alias(here), F.col("mark").alias(mark)).distinct()
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col(here)) & (F.xxhash64(f"`{text_col}`") == F.col(mark)), "left_anti")
