"""Language model scoring by a hierarchical Pitman-Yor process over words in context, words and their letters.

Every preceding word has a restaurant (a text begins after the end of another): its customers are the training tokens that
follow it, its dishes words. Those restaurants share a parent, the restaurant of words without context, whose tables order words
that the letters spell. The letters (bytes of UTF-8, then an end) have a restaurant for every context of the preceding LETTERS
bytes of the word; contexts that end alike share a parent, the context without its farthest byte, down to one without
context over uniform bytes. A table of a restaurant is a customer of its parent; so the tables of pairs of words teach
the words, and the tables of the words teach the letters.

Seatings are sampled by Gibbs: all customers of a dish leave and come in again one after the other, at a new table with the
Chinese restaurant's chances given the other tables, lowered for early arrivals; those who open none are passed over by
drawing how many they are, so a dish with a billion customers costs about as many steps as it has tables. A Metropolis
step against the former seating makes this an exact block of the sampler. The dishes of a restaurant are seated side by
side, given the numbers of the sweep before. A pair of words that occurs once sits at one table, which needs no sampling.
Random numbers come from hashes of dish and step, so reruns agree whatever the partitions. The predictive probabilities
of several rounds are averaged.

Work is dealt by tables: blocks of documents with dictionaries of their own, blocks of words, parts of pairs of words (by the
first, those of a frequent first word by both), families of letter contexts with the same last two bytes. Blocks ask for
what they need by joins; only the letters' two lowest levels, 66,564 + 257 numbers at most, and a number for each block of words
pass the driver.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from millrace.llm.shared import discard, pieces
from millrace.llm.shared import written as stored

#: Preceding bytes of a letter's context.
LETTERS = 4
#: Discounts and strengths of the restaurants of words in context, of the words' and of the letters'.
PAIR_DISCOUNT, PAIR_STRENGTH, WORD_DISCOUNT, WORD_STRENGTH, DISCOUNT, STRENGTH = 0.8, 10.0, 0.8, 10.0, 0.5, 1.0
#: Symbols: 256 bytes, the end of a word, and what stands before its beginning.
END, BEFORE, WIDTH = 256, 257, 258
#: A block of documents ends at so many tokens or words, a block of words at so many places where blocks of documents have them, or bytes of them.
BLOCK_TOKENS, BLOCK_WORDS, BLOCK_PLACES, BLOCK_BYTES = 1 << 21, 1 << 18, 1 << 20, 1 << 24
#: Training tokens for each part of the pairs of words, and of a first word whose pairs are dealt over all parts.
PART_TOKENS, FREQUENT = 1 << 21, 1 << 16
#: Cells whose families are seated side by side.
FAMILY_CELLS = 1 << 19

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    """Of five documents about one: crc32 of the id as text leaves 1. Null ids are not held out, and teach nothing."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 1, F.lit(False))


# --- seating ---------------------------------------------------------------------------------------------------------


def draws(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers between 0 and 1 from a hash of each seed and the step."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64) + np.uint64((step + 1) & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series eight places above."""
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


#: Stretches of arrivals, eight to each doubling, in which the chances of a new table are thinned alike.
GRID = np.unique(np.floor(2 ** (np.arange(8 * 60) / 8)))
_FALL = (GRID[:-1] + GRID[1:] - 1) / 2
#: Turns that dishes take side by side.
TURNS = 192


def seated(customers: np.ndarray, start: np.ndarray, more: np.ndarray, discount: float, seed: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers who open a table, beside the first: arrays of dishes and of places in the order of arrival, dish by dish.

    With j of c customers at t tables the restaurant gives the next one a table of their own at odds of start + more * t to
    j - discount * t. Those odds are drawn here times (j / c) ^ discount, about what a table opened early costs the
    arrivals to come; log_weight() has what that leaves out. As chances fall with j, the next who may open one is drawn as
    if they stayed, and does with the chance's share of what it was. Dishes take their turns side by side, those
    of over TURNS turns then one by one.
    """
    dish = np.flatnonzero(customers > 1)
    j, t, found = np.ones(len(dish)), np.ones(len(dish)), []
    m = np.zeros(len(dish), np.int64)
    for turn in range(TURNS):
        if not len(dish):
            break
        c = customers[dish]
        z = (start[dish] + more[dish] * t) * np.minimum(_FALL[m] / c, 1) ** discount
        now, end = z / (z + j - discount * t), np.minimum(GRID[m + 1], c)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(now > 0, np.floor(np.log(draws(seed[dish], (step * TURNS + turn) * 2)) / np.log1p(-now)), np.inf)
        at = j + np.where(now >= 1, 0, gap)
        comes = at < end
        j = np.where(comes, at, end)
        opens = comes & (draws(seed[dish], (step * TURNS + turn) * 2 + 1) * now < z / (z + j - discount * t))
        found.append((dish[opens], j[opens]))
        j, t = j + comes, t + opens
        m += j >= GRID[m + 1]
        left = j < c
        dish, j, t, m = dish[left], j[left], t[left], m[left]
    for d, at, opened, stretch in zip(dish.tolist(), j.tolist(), t.tolist(), m.tolist(), strict=True):
        places = _one_by_one(int(customers[d]), float(start[d]), float(more[d]), discount, int(at), int(opened), stretch, np.random.default_rng([int(seed[d]) & (1 << 64) - 1, step]))
        found.append((np.full(len(places), d), np.array(places, float)))
    dishes, places = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*found, strict=True) if found else ((), ())))
    order = np.lexsort((places, dishes))
    return dishes[order].astype(np.int64), places[order]


def _one_by_one(customers: int, start: float, more: float, discount: float, j: int, t: int, m: int, random: np.random.Generator) -> list[int]:
    """The same turns for one dish with j customers at t tables."""
    places, drawn = [], iter(())
    while j < customers:
        z = (start + more * t) * min(_FALL[m] / customers, 1) ** discount
        now, end = z / (z + j - discount * t), min(int(GRID[m + 1]), customers)
        if now <= 0:
            return places
        pair = next(drawn, None)
        if pair is None:
            drawn = iter(random.random((1024, 2)).tolist())
            pair = next(drawn)
        gap = math.log(1 - pair[0]) / math.log1p(-now) if now < 1 else 0
        if gap >= end - j:
            j = end
        else:
            j += int(gap)
            if pair[1] * now < z / (z + j - discount * t):
                places.append(j)
                t += 1
            j += 1
        m += j >= GRID[m + 1]
    return places


def log_weight(customers: np.ndarray, start: np.ndarray, more: np.ndarray, discount: float, seating: tuple[np.ndarray, np.ndarray], lanes: np.ndarray) -> np.ndarray:
    """For the dishes `lanes` (those with tables beside the first are among them) the log of how much rarer seated() draws a seating than the restaurant does, up to a constant.

    That is the product of the sums of odds over all arrivals but the first, over the thinning of those who opened a table.
    Between two tables and within a stretch the sums are x, x + 1, x + 2, ...: a ratio of gamma functions.
    """
    dishes, places = seating
    cuts = np.searchsorted(GRID, customers[lanes], side="left") - 1  # stretches that end before the last arrival
    row = np.repeat(np.arange(len(lanes)), cuts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    # arrivals come to an end of a run at a table, at a stretch, and at the last
    lane = np.concatenate([dishes, lanes[row], lanes])
    end = np.concatenate([places + 1, GRID[inside + 1], customers[lanes]])
    opens = np.zeros(len(lane), np.int64)
    opens[: len(dishes)] = 1
    order = np.lexsort((end, lane))
    lane, end, opens = lane[order], end[order], opens[order]
    first = np.ones(len(lane), bool)
    first[1:] = lane[1:] != lane[:-1]
    begin = np.where(first, 1, np.concatenate([[1], end[:-1]])) if len(lane) else end
    so_far = np.cumsum(opens) - opens
    t = 1 + so_far - so_far[np.maximum.accumulate(np.where(first, np.arange(len(lane)), 0))] if len(lane) else so_far
    thin = lambda d, at: np.minimum(_FALL[np.searchsorted(GRID, at, side="right") - 1] / customers[d], 1) ** discount
    y = (start[lane] + more[lane] * t) * thin(lane, begin) - discount * t
    total = np.bincount(lane, log_gamma(end + y) - log_gamma(begin + y), len(customers)).astype(np.float64)
    return total - np.bincount(dishes, np.log(thin(dishes, places)), len(customers))


def tables(customers: np.ndarray, seating: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Tables of every dish; before anybody was seated one each."""
    return (customers > 0) + (np.bincount(seating[0], minlength=len(customers)) if seating is not None else 0)


def sweep(customers: np.ndarray, start: np.ndarray, more: np.ndarray, discount: float, seed: np.ndarray, step: int, old: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs step of every dish: a new seating, or the old one where the Metropolis step declines; the first is taken as drawn."""
    new = seated(customers, start, more, discount, seed, step)
    if old is None:
        return new
    stay = old[1] < customers[old[0]]  # of customers who are no longer there
    old = old[0][stay], old[1][stay]
    changed = np.unique(np.concatenate([new[0], old[0]]))  # a dish with one table before and after weighs the same
    gain = log_weight(customers, start, more, discount, new, changed) - log_weight(customers, start, more, discount, old, changed)
    taken = np.log(draws(seed, -1 - step)) < gain
    a, b = taken[new[0]], ~taken[old[0]]
    dishes, places = np.concatenate([new[0][a], old[0][b]]), np.concatenate([new[1][a], old[1][b]])
    order = np.argsort(dishes, kind="stable")
    return dishes[order], places[order]


def served(customers: np.ndarray, taken: np.ndarray, base: np.ndarray, room: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Predictive probability of each dish in its restaurant (numbers `room`)."""
    here, used = np.bincount(room, customers)[room], np.bincount(room, taken)[room]
    return (customers - discount * taken + (strength + discount * used) * base) / (strength + here)


# --- letters ---------------------------------------------------------------------------------------------------------


def letter_keys(words: bytes, lengths: np.ndarray, letters: int = LETTERS) -> np.ndarray:
    """The cells (context, letter) of all words as numbers to the base WIDTH, one per byte and one for each end."""
    size = lengths.astype(np.int64) + 1
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    symbols = np.full(len(row), END, np.int64)
    symbols[inside < lengths[row]] = np.frombuffer(words, np.uint8)
    keys = symbols.copy()
    for back in range(1, letters + 1):
        before = np.full(len(row), BEFORE, np.int64)
        before[back:] = np.where(inside[back:] >= back, symbols[:-back], BEFORE)
        keys += before * WIDTH**back
    return keys


def family_seats(keys: np.ndarray, customers: np.ndarray, lower: np.ndarray, letters: int, sweeps: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictive probabilities of a family's cells; its cells with one letter of context, and the customers it sends them.

    keys are distinct and share the last two letters of their contexts; lower has the probabilities with one.
    """
    cells, up = {letters: keys}, {}
    for m in range(letters, 2, -1):
        cells[m - 1], up[m] = np.unique(cells[m] % WIDTH**m, return_inverse=True)
    room = {m: np.unique(k // WIDTH, return_inverse=True)[1] for m, k in cells.items()}
    seats, count, taken, p = dict.fromkeys(cells), {letters: customers}, {}, {}

    def learn() -> None:
        for m in range(2, letters + 1):
            p[m] = served(count[m], taken[m], base(m), room[m], DISCOUNT, STRENGTH)

    def base(m: int) -> np.ndarray:
        return p[m - 1][up[m]] if m > 2 else lower[cells[2] % WIDTH**2]

    def send(m: int) -> None:
        taken[m] = tables(count[m], seats[m])
        if m > 2:
            count[m - 1] = np.bincount(up[m], taken[m], len(cells[m - 1])).astype(np.int64)

    for m in range(letters, 1, -1):
        send(m)
    learn()
    for s in range(sweeps):
        for m in range(letters, 1, -1):
            others = np.bincount(room[m], taken[m])[room[m]] - taken[m]
            seats[m] = sweep(count[m], (STRENGTH + DISCOUNT * others) * base(m), DISCOUNT * base(m), DISCOUNT, cells[m].astype(np.uint64) * np.uint64(31) + np.uint64(m), step * sweeps + s, seats[m])
            send(m)
        learn()
    return p[letters], cells[2] % WIDTH**2, taken[2]


def lower_levels(keys: np.ndarray, customers: np.ndarray, sweeps: int, step: int) -> np.ndarray:
    """Probabilities of every letter after every single letter, an array of WIDTH * WIDTH, from customers of the cells `keys`."""
    count = np.zeros(WIDTH * WIDTH, np.int64)
    np.add.at(count, keys, customers)
    cell = np.arange(WIDTH * WIDTH)
    room, letter = cell // WIDTH, cell % WIDTH
    everywhere, uniform = np.zeros(WIDTH, np.int64), np.full(WIDTH, 1 / (END + 1))
    seats = low = None
    p = uniform
    for s in range(sweeps + 1):
        if s:
            others = np.bincount(room, taken)[room] - taken
            seats = sweep(count, (STRENGTH + DISCOUNT * others) * p[letter], DISCOUNT * p[letter], DISCOUNT, cell.astype(np.uint64) * np.uint64(31) + np.uint64(1), step * sweeps + s, seats)
        taken = tables(count, seats)
        below = np.bincount(letter, taken, WIDTH).astype(np.int64)
        if s:
            others = everywhere.sum() - everywhere
            low = sweep(below, (STRENGTH + DISCOUNT * others) * uniform, DISCOUNT * uniform, DISCOUNT, np.arange(WIDTH, dtype=np.uint64) * np.uint64(31), step * sweeps + s, low)
        everywhere = tables(below, low)
        p = served(below, everywhere, uniform, np.zeros(WIDTH, np.int64), DISCOUNT, STRENGTH)
    return served(count, taken, p[letter], room, DISCOUNT, STRENGTH)


# --- tables ----------------------------------------------------------------------------------------------------------


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers below 256^width by planes of bytes, of which the upper ones compress well, after how many they are."""
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def how_many(planes: bytes) -> int:
    return int.from_bytes(planes[:8], "little")


def unpacked(planes: bytes, width: int = 4) -> np.ndarray:
    size = how_many(planes)
    if not size:
        return np.zeros(0, np.int64)
    plain = pa.decompress(pa.py_buffer(planes)[8:], size * width, "zstd")
    return np.frombuffer(plain, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def _nullable(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    """Rows of which each has some of the schema's columns."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _listed(rows: DataFrame, by: str, of: str, *columns: str) -> DataFrame:
    """Rows (by, of): for each value the list of what was sent to it."""
    return rows.groupBy(F.col(by).alias(f"to_{of}")).agg(F.collect_list(F.struct(*columns)).alias(of))


def _joined(rows: DataFrame, lists: DataFrame, by: str, how: str = "inner") -> DataFrame:
    to = next(c for c in lists.columns if c.startswith("to_"))
    return rows.join(lists, F.col(by) == F.col(to), how).drop(to)


def _sequences(kind: pa.DataType):
    """Blocks of documents: a row with the words of all in their order, rows with the words that the block's numbers stand for."""
    one = pa.struct([("doc_id", kind), ("held_out", pa.bool_()), ("teaches", pa.bool_())])
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(one)), ("sizes", pa.binary()), ("tokens", pa.binary()), ("id", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple[list, list, defaultdict, int]:
            known = defaultdict()
            known.default_factory = known.__len__
            return [], [], known, 0

        number = TaskContext.get().partitionId() << 24
        docs, texts, known, tokens = empty()

        def block() -> Iterator[pa.RecordBatch]:
            words = list(known)
            n = np.zeros(len(words), np.int64)
            for doc, ids in zip(docs, texts, strict=True):
                if doc["teaches"]:
                    np.add.at(n, ids, 1)
            yield _nullable(schema, [{"block": number, "docs": docs, "sizes": packed(np.array([len(ids) for ids in texts])), "tokens": packed(np.concatenate(texts))}])
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), pa.nulls(m, pa.list_(one)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n[a : a + m])], schema=schema)

        for batch in (b for whole in batches for b in pieces(iter([whole]), "text")):
            for doc, held, teaches, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "teaches", "text")), strict=True):
                words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
                words.append(b"")  # the end of the text
                texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                docs.append({"doc_id": doc, "held_out": held, "teaches": teaches})
                tokens += len(words)
                if tokens > BLOCK_TOKENS or len(known) > BLOCK_WORDS:
                    yield from block()
                    number += 1
                    docs, texts, known, tokens = empty()
        if docs:
            yield from block()

    return run


WORDS = "block long, words binary, lengths binary, counts binary, seeds binary"


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, block, id, n, seed) in the order of words as blocks of words: their bytes, lengths, counts and seeds.

    A row more for each block of documents, `docs`, with its numbers of those words, their places in the block, and counts.
    """
    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "lengths", "counts", "seeds")), ("docs", pa.int64()), ("ids", pa.binary()), ("at", pa.binary())])

    def block(rows: pa.Table) -> pa.RecordBatch:
        word = rows.column("word").combine_chunks()
        docs, ids, n, seed = (rows.column(c).to_numpy() for c in ("block", "id", "n", "seed"))
        first = np.ones(len(word), bool)
        first[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        place = np.cumsum(first) - 1
        counts = np.zeros(place[-1] + 1, np.int64)
        np.add.at(counts, place, n)
        words = word.filter(pa.array(first))
        out = [{"block": number, "words": b"".join(words.to_pylist()), "lengths": packed(pc.binary_length(words).to_numpy()), "counts": counts.tobytes(), "seeds": seed[first].tobytes()}]
        order = np.argsort(docs, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1):
            out.append({"block": number, "docs": int(docs[own[0]]), "ids": packed(ids[own]), "at": packed(place[own]), "counts": packed(counts[place[own]], 8)})
        return _nullable(schema, out)

    for batch in (b for whole in batches for b in pieces(iter([whole]), "word")):
        held, size = [*held, batch], size + batch.column("word").nbytes
        if sum(b.num_rows for b in held) > BLOCK_PLACES or size > BLOCK_BYTES:
            whole = pa.Table.from_batches(held)
            word = whole.column("word")
            cut = pc.index(word, word[-1]).as_py()  # the last word may go on
            if cut:
                yield block(whole.slice(0, cut))
                number, held = number + 1, whole.slice(cut).to_batches()
                size = sum(pc.sum(pc.binary_length(b.column("word"))).as_py() for b in held)
    if held:
        yield block(pa.Table.from_batches(held))


# --- pairs of words --------------------------------------------------------------------------------------------------


class Places:
    """Numbers of all words: those of a block of words follow one another."""

    def __init__(self, sizes: list[tuple[int, int]]):
        self.blocks = sorted(b for b, _ in sizes)
        size = dict(sizes)
        self.starts = np.cumsum([0, *(size[b] for b in self.blocks)])

    def start(self, block: int) -> int:
        return int(self.starts[bisect.bisect_left(self.blocks, block)])

    def cut(self, numbers: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Blocks with their stretch of sorted numbers, and the places there."""
        edges = np.searchsorted(numbers, self.starts)
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(int(edges[i]), int(edges[i + 1]))
            yield self.blocks[i], own, numbers[own] - self.starts[i]


class BlockPairs:
    """Distinct pairs of a block of documents: u, w (numbers in the block), the pair of each token (`of`), and the pairs asked for by part."""

    def __init__(self, sizes: bytes, tokens: bytes, told: list[dict], places: Places, parts: int, frequent: int):
        size = sum(how_many(t["ids"]) for t in told)
        self.number, self.counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for t in told:
            ids = unpacked(t["ids"])
            self.number[ids] = unpacked(t["at"]) + places.start(t["block"])
            self.counts[ids] = unpacked(t["counts"], 8)
        self.sizes, self.tokens = unpacked(sizes), unpacked(tokens)
        ends = np.cumsum(self.sizes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[ends - self.sizes] = self.tokens[ends - 1]  # a text begins after an end
        keys, self.of = np.unique(before * size + self.tokens, return_inverse=True)
        self.u, self.w = np.divmod(keys, size)
        asked = np.flatnonzero((self.counts[self.u] > 0) & (self.counts[self.w] > 0))  # others were never taught
        u, w = self.number[self.u[asked]], self.number[self.w[asked]]
        with np.errstate(over="ignore"):
            mixed = u.astype(np.uint64) + np.where(self.counts[self.u[asked]] >= frequent, w + 1, 0).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((u << 32 | w, part))
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        self.asked = {int(part[own[0]]): asked[own] for own in np.split(order, cuts) if len(own)}


def _requests(places: Places, parts: int, frequent: int):
    """Rows (part, docs, us, runs, ws, ns): the pairs of each block of documents, with how often they were taught there."""
    schema = pa.schema([("part", pa.int64()), ("docs", pa.int64()), *((c, pa.binary()) for c in ("us", "runs", "ws", "ns"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                pairs = BlockPairs(row["sizes"], row["tokens"], row["told"], places, parts, frequent)
                teaches = np.repeat(np.array([d["teaches"] for d in row["docs"]]), pairs.sizes)
                n = np.bincount(pairs.of[teaches], minlength=len(pairs.u))
                for part, own in pairs.asked.items():
                    u, w = pairs.number[pairs.u[own]], pairs.number[pairs.w[own]]
                    first = np.flatnonzero(np.diff(u, prepend=-1))
                    yield _nullable(schema, [{"part": part, "docs": row["block"], "us": packed(u[first]), "runs": packed(np.diff(first, append=len(u))), "ws": packed(w), "ns": packed(n[own])}])

    return run


#: Parts: pairs that occur several times with their seats; what they send to blocks of words; what blocks of documents asked.
PARTS = "part long, us binary, ws binary, ns binary, dishes binary, places binary, kept array<binary>, block long, fixed boolean, at binary, customers binary, tables binary, docs long"
_PARTS = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("us", "ws", "ns", "dishes", "places")), ("kept", pa.list_(pa.binary())), ("block", pa.int64()), ("fixed", pa.bool_()), *((c, pa.binary()) for c in ("at", "customers", "tables")), ("docs", pa.int64())])


def _sent(part: int, u: np.ndarray, w: np.ndarray, t: np.ndarray, fixed: bool, places: Places) -> Iterator[pa.RecordBatch]:
    """The tables of pairs as customers of their words, and as tables of their contexts, for each block of words."""
    words = np.unique(np.concatenate([u, w]))
    customers, tables_of = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    np.add.at(customers, np.searchsorted(words, w), t)
    np.add.at(tables_of, np.searchsorted(words, u), t)
    for block, own, at in places.cut(words):
        yield _nullable(_PARTS, [{"part": part, "block": block, "fixed": fixed, "at": packed(at), "customers": packed(customers[own], 8), "tables": packed(tables_of[own], 8)}])


def _parted(places: Places):
    """Requests of a part as its pairs, counted over all blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                part, asked = row["part"], row["asked"]
                keys = [np.repeat(unpacked(a["us"]), unpacked(a["runs"])) << 32 | unpacked(a["ws"]) for a in asked]
                ends = np.cumsum([len(k) for k in keys])
                keys, at = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, at, np.concatenate([unpacked(a["ns"]) for a in asked]))
                many, once = n > 1, keys[n == 1]
                index = np.cumsum(many) - 1
                for a, own in zip(asked, np.split(at, ends[:-1]), strict=True):
                    yield _nullable(_PARTS, [{"part": part, "docs": a["docs"], "ns": packed(n[own], 8), "at": packed(index[own[many[own]]])}])
                yield from _sent(part, once >> 32, once & 0xFFFFFFFF, np.ones(len(once), np.int64), True, places)
                keys, n = keys[many], n[many]
                u, w = keys >> 32, keys & 0xFFFFFFFF
                yield _nullable(_PARTS, [{"part": part, "us": packed(u), "ws": packed(w), "ns": packed(n, 8)}])
                yield from _sent(part, u, w, np.ones(len(n), np.int64), False, places)

    return run


def _pair_seats(places: Places, words_at: tuple[float, float], step: int, keeps: bool):
    """Parts with their pairs' tables sampled anew, given what the blocks of words answered; words_at has the tables and customers of all words."""
    total, customers = words_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                u, w, n = unpacked(row["us"]), unpacked(row["ws"]), unpacked(row["ns"], 8)
                words = np.unique(np.concatenate([u, w]))
                told = sorted(row.pop("told") or [], key=lambda t: t["block"])
                gather = lambda c, width: np.concatenate([unpacked(t[c], width) for t in told]) if told else np.zeros(0, np.int64)
                here, taken, used, seeds = gather("customers", 8), gather("tables", 8), gather("contexts", 8), gather("seeds", 4)
                spelled = np.concatenate([np.frombuffer(t["letters"]) for t in told]) if told else np.zeros(0)
                base = np.exp(np.logaddexp(np.log(here - WORD_DISCOUNT * taken), math.log(WORD_STRENGTH + WORD_DISCOUNT * total) + spelled) - math.log(WORD_STRENGTH + customers))
                first, second = np.searchsorted(words, u), np.searchsorted(words, w)
                old = (unpacked(row["dishes"]), unpacked(row["places"], 8).astype(np.float64)) if row["dishes"] is not None else None
                base, others = base[second], used[first] - tables(n, old)
                seats = sweep(n, (PAIR_STRENGTH + PAIR_DISCOUNT * others) * base, PAIR_DISCOUNT * base, PAIR_DISCOUNT, seeds[first] << 32 | seeds[second], step, old)
                t = tables(n, seats)
                row["dishes"], row["places"] = packed(seats[0]), packed(seats[1], 8)
                if keeps:
                    row["kept"] = [*(row["kept"] or []), packed(t, 8)]
                yield _nullable(_PARTS, [row])
                yield from _sent(row["part"], u, w, t, False, places)

    return run


def _pair_answers(used: int):
    """Rows (docs, part, ns, tables): how often the pairs that a block of documents asked for were taught, and the tables of those taught several times."""
    schema = pa.schema([("docs", pa.int64()), ("part", pa.int64()), ("ns", pa.binary()), ("tables", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                n = unpacked(row["ns"], 8)
                kept = [unpacked(t, 8) for t in row["kept"] or []]
                kept = [*([np.ones(len(n), np.int64)] * (used - len(kept))), *kept]  # before the first sweep one each
                for a in row["asked"]:
                    at = unpacked(a["at"])
                    yield _nullable(schema, [{"docs": a["docs"], "part": row["part"], "ns": a["ns"], "tables": [packed(t[at], 8) for t in kept]}])

    return run


# --- words and documents ---------------------------------------------------------------------------------------------


def _asked(letters: int):
    """Rows (key, block, customers): the letter cells of each block of words, and the tables of words that the block holds there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, counts = unpacked(row["lengths"]), np.frombuffer(row["counts"], np.int64)
                ordered = unpacked(row["tables"], 8) if row["tables"] else (counts > 0).astype(np.int64)
                keys, at = np.unique(letter_keys(row["words"], lengths, letters), return_inverse=True)
                customers = np.bincount(at, np.repeat(ordered, lengths + 1), len(keys)).astype(np.int64)
                for a in range(0, len(keys), 1 << 16):
                    k = keys[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([row["block"]] * len(k), pa.int64()), pa.array(customers[a : a + len(k)])], names=["key", "block", "customers"])

    return run


#: Blocks of words with their seats, customers and tables of their contexts (fixed: of pairs that occur once), those kept of each round; what they answer to parts.
SEATS = f"{WORDS}, tables binary, dishes binary, places binary, customers binary, fixed_customers binary, fixed_contexts binary, spelled array<binary>, seats array<binary>, sat array<binary>, used array<binary>, part long, contexts binary, letters binary"
_SEATS = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("words", "lengths", "counts", "seeds", "tables", "dishes", "places", "customers", "fixed_customers", "fixed_contexts")), *((c, pa.list_(pa.binary())) for c in ("spelled", "seats", "sat", "used")), ("part", pa.int64()), ("contexts", pa.binary()), ("letters", pa.binary())])


def _spelled(letters: int, tables_before: float, step: int, keeps: bool, answers: bool):
    """Blocks of words with their tables sampled anew, given the letters' probabilities that each block asked for, and the pairs' tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c).to_pylist()[0] for c in _SEATS.names}
                told = one.column("told").flatten()
                keys, p = told.field("key").to_numpy(), told.field("p").to_numpy()
                order = np.argsort(keys)
                keys, logs = keys[order], np.log(p[order])
                lengths, counts, seeds = unpacked(row["lengths"]), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["seeds"], np.int64)
                asked = letter_keys(row["words"], lengths, letters)
                log_base = np.add.reduceat(logs[np.searchsorted(keys, asked)], np.cumsum(lengths + 1) - lengths - 1)
                base = np.exp(log_base)
                messages = one.column("sent").to_pylist()[0] or []
                sums = {}
                for fixed in (True, False):
                    now = [m for m in messages if m["fixed"] == fixed]
                    for c in ("customers", "tables"):
                        sums[fixed, c] = np.zeros(len(counts), np.int64)
                        for m in now:
                            sums[fixed, c][unpacked(m["at"])] += unpacked(m[c], 8)
                if row["fixed_customers"] is None:
                    row["fixed_customers"], row["fixed_contexts"] = packed(sums[True, "customers"], 8), packed(sums[True, "tables"], 8)
                customers = unpacked(row["fixed_customers"], 8) + sums[False, "customers"]
                contexts = unpacked(row["fixed_contexts"], 8) + sums[False, "tables"]
                old = (unpacked(row["dishes"]), unpacked(row["places"], 8).astype(np.float64)) if row["tables"] else None
                if old is not None:
                    stay = old[1] < customers[old[0]]  # of customers who are no longer there
                    old = old[0][stay], old[1][stay]
                others = np.maximum(max(tables_before, 1.0) - tables(customers, old), 0)
                seats = sweep(customers, (WORD_STRENGTH + WORD_DISCOUNT * others) * base, WORD_DISCOUNT * base, WORD_DISCOUNT, seeds, step, old)
                taken = tables(customers, seats)
                row["dishes"], row["places"] = packed(seats[0]), packed(seats[1], 8)
                row["tables"], row["customers"] = packed(taken, 8), packed(customers, 8)
                if keeps:
                    for c, now in (("spelled", log_base.tobytes()), ("seats", row["tables"]), ("sat", row["customers"]), ("used", packed(contexts, 8))):
                        row[c] = [*(row[c] or []), now]
                yield _nullable(_SEATS, [row])
                for m in messages:
                    if answers and not m["fixed"]:
                        at = unpacked(m["at"])
                        yield _nullable(_SEATS, [{"block": row["block"], "part": m["part"], "customers": packed(customers[at], 8), "tables": packed(taken[at], 8), "contexts": packed(contexts[at], 8), "letters": log_base[at].tobytes(), "seeds": packed(seeds[at] & 0xFFFFFFFF)}])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables and customers of blocks of words."""
    for batch in batches:
        sums = [[int(unpacked(t, 8).sum()) for t in batch.column(c).to_pylist()] for c in ("tables", "customers")]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sums], names=["t", "c"])


def _given(used: list[tuple[float, float]]):
    """Rows (docs, block, ids, at, counts, logs, contexts): what a block of documents needs to know of a block of words; logarithms of the words' probabilities without context, and the tables of their own restaurants, for each round used."""
    schema = pa.schema([("docs", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "at", "counts")), ("logs", pa.list_(pa.binary())), ("contexts", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                logs = []
                for (total, customers), spelled, seats, sat in zip(used, row["spelled"], row["seats"], row["sat"], strict=True):
                    with np.errstate(divide="ignore"):
                        own = np.log(unpacked(sat, 8) - WORD_DISCOUNT * unpacked(seats, 8))
                    logs.append(np.logaddexp(own, math.log(WORD_STRENGTH + WORD_DISCOUNT * total) + np.frombuffer(spelled)) - math.log(WORD_STRENGTH + customers))
                contexts = [unpacked(c, 8) for c in row["used"]]
                for m in row["wanted"]:
                    at = unpacked(m["at"])
                    yield _nullable(schema, [{"docs": m["docs"], "block": row["block"], "ids": m["ids"], "at": m["at"], "counts": m["counts"], "logs": [x[at].tobytes() for x in logs], "contexts": [packed(c[at], 8) for c in contexts]}])

    return run


def _document_scores(kind: pa.DataType, used: int, train_tokens: int, train_words: int, places: Places, parts: int, frequent: int):
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                docs, told = row["docs"], row["told"]
                pairs = BlockPairs(row["sizes"], row["tokens"], told, places, parts, frequent)
                n, some = np.zeros(len(pairs.u), np.int64), np.zeros((used, len(pairs.u)), np.int64)
                for a in row["answered"] or []:
                    own = pairs.asked[a["part"]]
                    n[own] = unpacked(a["ns"], 8)
                    some[:, own] = n[own] > 0
                    for r in range(used):
                        some[r, own[n[own] > 1]] = unpacked(a["tables"][r], 8)
                score = np.full(len(n), -np.inf)
                for r in range(used):
                    alone, contexts = np.zeros(len(pairs.number)), np.zeros(len(pairs.number), np.int64)
                    for t in told:
                        ids = unpacked(t["ids"])
                        alone[ids], contexts[ids] = np.frombuffer(t["logs"][r]), unpacked(t["contexts"][r], 8)
                    with np.errstate(divide="ignore"):
                        own = np.log(n - PAIR_DISCOUNT * some[r])
                    within = np.logaddexp(own, np.log(PAIR_STRENGTH + PAIR_DISCOUNT * contexts[pairs.u]) + alone[pairs.w]) - np.log(PAIR_STRENGTH + pairs.counts[pairs.u])
                    score = np.logaddexp(score, within)
                score = np.minimum((score - math.log(used)) / math.log(10), 0.0)
                base = np.log10((pairs.counts + 0.5) / (train_tokens + 0.5 * (train_words + 1)))
                of = np.repeat(np.arange(len(docs)), pairs.sizes)
                sums = [np.bincount(of, x, len(docs)) for x in ((pairs.counts > 0)[pairs.tokens], base[pairs.tokens], score[pairs.of])]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in docs], kind), pa.array([d["held_out"] for d in docs], pa.bool_()), pa.array(pairs.sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=schema)

    return run


def _taught(words: DataFrame) -> tuple[int, int, list[tuple[int, int]]]:
    """Tokens and distinct tokens that blocks of words were taught, and the sizes of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(c, np.int64) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([len(c) for c in counts], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], names=["block", "size", "n", "v"])

    rows = words.select("block", "counts").mapInArrow(run, "block long, size long, n long, v long").collect()
    return sum(r.n for r in rows), sum(r.v for r in rows), [(r.block, r.size) for r in rows]


def _families(cells: DataFrame, lower: np.ndarray, letters: int, sweeps: int, step: int) -> DataFrame:
    """Rows (key, p, customers): each cell's probability, and without p what the families send to cells with one letter of context.

    A task seats the families of its partition some FAMILY_CELLS cells at a time; a family is at most all cells with
    letters - 2 free bytes.
    """
    given = cells.sparkSession.sparkContext.broadcast(lower)
    schema = pa.schema([("key", pa.int64()), ("p", pa.float64()), ("customers", pa.int64())])

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def several(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            order = np.argsort(keys := whole.column("key").to_numpy())
            keys = keys[order]
            p, below, sent = family_seats(keys, whole.column("customers").to_numpy()[order], given.value, letters, sweeps, step)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p), pa.nulls(len(keys), pa.int64())], schema=schema)
            below, at = np.unique(below, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(below), pa.nulls(len(below), pa.float64()), pa.array(np.bincount(at, sent).astype(np.int64))], schema=schema)

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size > FAMILY_CELLS:
                whole = pa.Table.from_batches(held)
                family = whole.column("family").to_numpy()
                cut = int(np.searchsorted(family, family[-1]))  # the last family may go on
                if cut:
                    yield from several(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            yield from several(pa.Table.from_batches(held))

    named = cells.withColumn("family", F.expr(f"(key DIV {WIDTH}) % {WIDTH**2}"))
    return named.repartition("family").sortWithinPartitions("family").mapInArrow(seats, "key long, p double, customers long")


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name, compression="zstd")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What the rounds shuffled is deleted once it is written, not when the driver's memory is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, letters: int = LETTERS, rounds: int = 3, burn_in: int = 1, sweeps: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs.

    A text's tokens are its words between white space, A-Z made small, and its end. All rows but those held out (as a
    default every fifth by its id; null ids teach nothing) teach, with all their tokens. base_score sums log10((c + 0.5) /
    (N + 0.5 (V + 1))), c a token's count, N all, V the distinct tokens taught; n_known counts tokens with c > 0. score sums
    the logarithms of the model's probabilities, averaged over rounds - burn_in rounds of Gibbs sampling, each of one sweep
    of the pairs of words (from the second on), one of the words, which go on from the round before, and `sweeps` of the letters; perplexity is
    10^(-score / n_tokens). Null and empty texts have the end alone; without teaching rows every word is spelled by
    uniform letters. Repeated rows count and come out each; equal texts score alike; further columns are ignored. A
    text's distinct words are held by one task, and a word of any length whole.
    """
    if not 2 <= letters <= 6 or rounds <= burn_in:
        raise ValueError("letters are 2 to 6, and rounds more than burn_in")
    held = held_out(id_col) if held is None else F.coalesce(held, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held.alias("held_out"), (~held & F.col(f"`{id_col}`").isNotNull()).alias("teaches"))
    kind, name = to_arrow_type(rows.schema["doc_id"].dataType), rows.schema["doc_id"].dataType.simpleString()
    with _shuffles_deleted(docs.sparkSession):
        texts = written(rows.mapInArrow(_sequences(kind), f"block long, docs array<struct<doc_id:{name},held_out:boolean,teaches:boolean>>, sizes binary, tokens binary, id int, word binary, n long"), "texts")
        whole = texts.where("docs IS NOT NULL").select("block", "docs", "sizes", "tokens")
        dealt = texts.where("word IS NOT NULL").select("word", "block", "id", "n").repartition("word").sortWithinPartitions("word", "block")
        words = written(dealt.withColumn("seed", F.xxhash64("word")).mapInArrow(_word_blocks, f"{WORDS}, docs long, ids binary, at binary"), "words")
        wanted = words.where("docs IS NOT NULL").select("block", "docs", "ids", "at", "counts")
        plain = words.where("docs IS NULL").select("block", "words", "lengths", "counts", "seeds")
        n, v, sizes = _taught(plain)

        places, parts, frequent = Places(sizes), n // PART_TOKENS + 1, FREQUENT
        requests = _joined(whole, _listed(wanted, "docs", "told", "block", "ids", "at", "counts"), "block").mapInArrow(_requests(places, parts, frequent), "part long, docs long, us binary, runs binary, ws binary, ns binary")
        pairs = written(_listed(requests, "part", "asked", "docs", "us", "runs", "ws", "ns").withColumnRenamed("to_asked", "part").mapInArrow(_parted(places), PARTS), "pairs")
        now = pairs
        blocks = plain.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SEATS) if f.name not in plain.columns))

        lower, words_at, used, last = None, (float(v), 0.0), [], None
        for r in range(rounds):
            own = blocks.where("part IS NULL")
            if r:  # the first time every pair has one table
                told = _listed(blocks.where("part IS NOT NULL"), "part", "told", "block", "customers", "tables", "contexts", "letters", "seeds")
                state = now.where("us IS NOT NULL").select("part", "us", "ws", "ns", "dishes", "places", "kept")
                before, now = now, written(_joined(state, told, "part", "left").mapInArrow(_pair_seats(places, words_at, r, r >= burn_in), PARTS), "pairs")
                if before is not pairs:
                    discard(before)
            asked = written(own.mapInArrow(_asked(letters), "key long, block long, customers long"), "asked")
            cells = written(asked.groupBy("key").agg(F.sum("customers").alias("customers")), "cells")
            if lower is None:  # the first time every cell that has customers sends one
                found = cells.where("customers > 0").groupBy((F.col("key") % WIDTH**2).alias("key")).agg(F.count("*").alias("customers")).toPandas()
                lower = lower_levels(found["key"].to_numpy(np.int64), found["customers"].to_numpy(np.int64), sweeps, r)
            told = written(_families(cells, lower, letters, sweeps, r), "letters")
            found = told.where("p IS NULL").groupBy("key").agg(F.sum("customers").alias("customers")).toPandas()
            lower = lower_levels(found["key"].to_numpy(np.int64), found["customers"].to_numpy(np.int64), sweeps, r + 1)
            answers = asked.select("key", "block").join(told.where("p IS NOT NULL").select("key", "p"), "key").groupBy(F.col("block").alias("to_told")).agg(F.collect_list(F.struct("key", "p")).alias("told"))
            sent = _listed(now.where("block IS NOT NULL"), "block", "sent", "part", "fixed", "at", "customers", "tables")
            spelled = _joined(_joined(own, answers, "block"), sent, "block", "left").mapInArrow(_spelled(letters, words_at[0], r, r >= burn_in, r + 1 < rounds), SEATS)
            blocks = written(spelled, "seats")
            discard(asked, cells, told, *([last] if last is not None else []))
            last = blocks
            sums = blocks.where("part IS NULL").select("tables", "customers").mapInArrow(_totals, "t long, c long").agg(F.sum("t"), F.sum("c")).first()
            words_at = float(sums[0] or 0), float(sums[1] or 0)
            if r >= burn_in:
                used.append(words_at)

        state = now.where("us IS NOT NULL").select("part", "ns", "kept")
        answered = written(_joined(state, _listed(pairs.where("docs IS NOT NULL"), "part", "asked", "docs", "ns", "at"), "part").mapInArrow(_pair_answers(len(used)), "docs long, part long, ns binary, tables array<binary>"), "answered")
        discard(*({id(t): t for t in (pairs, now)}.values()))
        own = blocks.where("part IS NULL").select("block", "spelled", "seats", "sat", "used")
        given = written(_joined(own, _listed(wanted, "block", "wanted", "docs", "ids", "at", "counts"), "block").mapInArrow(_given(used), "docs long, block long, ids binary, at binary, counts binary, logs array<binary>, contexts array<binary>"), "given")
        discard(words, blocks)

    whole = _joined(whole, _listed(given, "docs", "told", "block", "ids", "at", "counts", "logs", "contexts"), "block")
    whole = _joined(whole, _listed(answered, "docs", "answered", "part", "ns", "tables"), "block", "left")
    out = whole.mapInArrow(_document_scores(kind, len(used), n, v, places, parts, frequent), f"doc_id {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
