"""Source divergence, Merkle manifest and language model on small tables with every awkward row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence, language_model, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns with names that the operators use inside.
CLASH = ", tree string, block long, node string, place long, term string, times long, overall long, number long, word string, n long, id int, key long, held_out boolean, leaf string, of string"
EXTRA = ("t", 1, "n", 2, "x", 3, 4, 5, "w", 6, 7, 8, True, "l", "o")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS + CLASH)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "x1y", "ÄB", "ab", "zz", "q"]
    rows = [(i, " ".join(rng.choices(words, [9, 6, 4, 3, 2, 2, 1, 1], k=rng.randrange(12))), rng.choice(["de", "en", None, ""]), rng.choice(["a", "b", "ß", None, "c", "d"]), rng.randrange(99)) for i in range(n)]
    return rows + [(n, None, None, None, None), (n + 1, "", "fr", "only", 0), (n + 2, "9 ,;", "fr", None, 3), (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4]), (None, "alpha " * 4000, "de", "hot", None)]


def plain_divergence(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        kept = sorted((t for t in {w for r in mine for w in r[2]} if sum(t in r[2] for r in mine) >= least), key=str.encode)
        count = {s: [sum(r[2].count(t) for r in mine if r[1] == s) for t in kept] for s in {r[1] for r in mine}}
        chance = lambda c: [1 + 1_000_000_000 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]  # noqa: B023, E731
        p, q = {s: chance(c) for s, c in count.items()}, chance([sum(x) for x in zip(*count.values(), strict=True)])
        for s in count:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in count if o != s]
            terms = [(p[s][i] - q[i], t) for i, t in enumerate(kept) if count[s][i] and p[s][i] > q[i]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CELLS", 8)
    rows = corpus(1, 150)
    got = [tuple(r) for r in divergence.divergence(table(spark, rows), least_docs=12, top=3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 12, 3)


def test_divergence_without_terms_or_rows(spark):
    rows = corpus(2, 20)
    got = {tuple(r) for r in divergence.divergence(table(spark, rows), least_docs=1000).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_divergence(rows, 1000, 50) and all(r[4] == 0 for r in got)
    assert divergence.divergence(table(spark, rows).limit(0)).count() == 0


def test_chances_are_exact():
    counts, whole = np.array([0, 1, 10**12, 7 * 10**14]), np.array([8 * 10**15])
    assert divergence.chances(counts, whole, 10**6).tolist() == [1 + 10**9 * (int(c) + 5) // (8 * 10**15 + 5 * 10**6) for c in counts]
    with pytest.raises(ValueError, match="more tokens"):
        divergence.chances(counts, np.array([10**16]), 1)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + more, text)))


def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded)} level by level."""

    def grow(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = range(p // 2 * 2, min(p // 2 * 2 + 2, len(nodes)))
                paths[i].append([(j < p, nodes[j]) for j in run if j != p])
            at = [p // 2 for p in at]
            nodes = [digest(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
        return nodes[0], paths

    trees = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        trees[r[2]].append(r)
    grown = {lang: grow([plain_leaf(r) for r in own]) for lang, own in trees.items()}
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    root, above = grow([grown[lang][0] for lang in order])
    out = {}
    for k, lang in enumerate(order):
        for r, path in zip(trees[lang], grown[lang][1], strict=True):
            node = plain_leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else plain_leaf(r)
            for level in path + above[k]:
                node = digest(*(s for left, s in level if left), node, *(s for left, s in level if not left))
            out.setdefault((r[0], plain_leaf(r)), set()).add((grown[lang][0], root, digest(*(s for level in path + above[k] for _, s in level)), node))
    return out


@pytest.mark.parametrize(("block_height", "n"), [(10, 40), (2, 90), (1, 33)])
def test_manifest(spark, monkeypatch, block_height, n):
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", block_height)
    rows = corpus(n, n)
    changed = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    got = merkle.manifest(table(spark, rows), {"n_chars": changed}).collect()
    want = plain_manifest(rows)
    assert len(got) == len(rows)
    found = collections.defaultdict(set)
    for r in got:
        found[r.doc_id, r.leaf].add((r.subroot, r.root, r.proof_sha256, r.folded_root))
        assert r.verified == (r.folded_root == r.root)
    assert found == want
    assert {r.doc_id for r in got if not r.verified} == {i for i, *_, n in rows if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}


def test_manifest_of_one_row_or_none(spark):
    only = table(spark, [(3, "x", None, "s", 1)])
    (row,) = merkle.manifest(only).collect()
    assert row.leaf == row.subroot == row.root == plain_leaf((3, "x", None, "s", 1)) and row.proof_sha256 == digest() and row.verified
    assert merkle.manifest(only.limit(0)).count() == 0
    (row,) = merkle.manifest(only, {"text": F.lit("other")}).collect()
    assert not row.verified


def test_traverse_matches_levels():
    for n in (1, 2, 3, 7, 8, 11):
        nodes = [digest(str(i)) for i in range(n)]
        root, paths = merkle.traverse(nodes, merkle.height(n))
        assert all(merkle.fold(a, p) == root and len(p) == merkle.height(n) for a, p in zip(nodes, paths, strict=True))


def stirling_tables(c, room, base, discount):
    """Exact chances of 0 to c tables of a dish with c customers, `room` = strength + discount * other tables."""
    s = np.zeros((c + 1, c + 1))
    s[0, 0] = 1
    for n in range(c):
        for t in range(n + 1):
            s[n + 1, t + 1] += s[n, t]
            s[n + 1, t] += s[n, t] * (n - discount * t)
    w = np.array([math.prod((room + discount * i) * base for i in range(t)) * s[c, t] for t in range(c + 1)])
    return w / w.sum()


@pytest.mark.parametrize(("c", "room", "base", "discount"), [(1, 2.0, 0.3, 0.5), (5, 2.0, 0.3, 0.5), (8, 50.0, 0.6, 0.5), (12, 4.0, 0.2, 0.7)])
def test_seating_has_the_exact_distribution(c, room, base, discount):
    n = 8000
    customers, start, more = np.full(n, c), np.full(n, room * base), np.full(n, discount * base)
    seats, seen = None, np.zeros(c + 1)
    for step in range(60):
        seats = language_model.sweep(customers, start, more, discount, np.arange(n, dtype=np.uint64), step, seats)
        if step >= 30:
            seen += np.bincount(language_model.tables(customers, seats), minlength=c + 1)
    assert np.abs(seen / seen.sum() - stirling_tables(c, room, base, discount)).max() < 0.01


@pytest.mark.parametrize(("c", "room", "base", "discount"), [(400, 1e6, 1e-5, 0.8), (300, 100.0, 0.1, 0.5), (600, 10.0, 0.01, 0.8)])
def test_seating_of_many_customers(c, room, base, discount):
    """Mean number of tables against the exact one; sums over numbers of tables in logarithms."""
    s = np.full(c + 2, -np.inf)
    s[0] = 0
    for n in range(c):
        stay = np.maximum(n - discount * np.arange(c + 2), 0)
        with np.errstate(divide="ignore"):
            s = np.logaddexp(np.concatenate([[-np.inf], s[:-1]]), s + np.log(stay))
    t = np.arange(1, c + 1)
    w = np.array([math.lgamma(room / discount + x) + x * math.log(discount * base) for x in t]) + s[1 : c + 1]
    w = np.exp(w - w.max())
    n, seats, means = 1500, None, []
    for step in range(30):
        seats = language_model.sweep(np.full(n, c), np.full(n, room * base), np.full(n, discount * base), discount, np.arange(n, dtype=np.uint64), step, seats)
        means.append(language_model.tables(np.full(n, c), seats).mean())
    assert abs(np.mean(means[15:]) / ((w * t).sum() / w.sum()) - 1) < 0.03


def test_a_billion_customers_take_few_steps():
    dish, places = language_model.seated(np.array([1_000_000_000]), np.array([20.0]), np.array([0.5]), 0.5, np.array([1], np.uint64), 0)
    assert 10 < len(dish) < 1000 and places.max() < 1_000_000_000 and (np.diff(places) > 0).all()
    one = language_model._one_by_one(1_000_000_000, 20.0, 0.5, 0.5, 1, 1, 0, np.random.default_rng(1))
    assert 10 < len(one) < 1000 and one == sorted(set(one))


def test_letters_are_a_distribution():
    """The letters after any context sum to one, seen or not."""
    words = [b"", b"ab", b"abc", "é".encode(), b"abcabc"]
    lengths = np.array([len(w) for w in words])
    keys = language_model.letter_keys(b"".join(words), lengths, 3)
    assert len(keys) == int(lengths.sum()) + len(words)
    context = keys[2] // language_model.WIDTH
    every = np.unique(np.concatenate([keys, context * language_model.WIDTH + np.arange(language_model.END + 1)]))
    lower = language_model.lower_levels(np.array([97 * 258 + 98]), np.array([4]), 2, 0)
    assert np.allclose(lower.reshape(258, 258)[:, :257].sum(1), 1)
    customers = np.bincount(np.searchsorted(every, keys), minlength=len(every))
    p, _, sent = language_model.family_seats(every, customers, lower, 3, 3, 0)
    assert math.isclose(p[every // language_model.WIDTH == context].sum(), 1) and sent.sum() <= len(keys)


def test_scores(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "The", "cat", "ran", "mat\x0bon", "über"], [5, 1, 3, 2, 1, 1], k=rng.randrange(1, 40))), "en", "s", 1) for i in range(120)]
    rows += [(200, None, "x", "y", 0), (201, "", None, None, None), (202, "unseenword " * 3000, "en", "s", 1), (7, rows[7][1], "en", "s", 1), (None, "nowhere else", "en", "s", 1), (203, "z" * 100_000, "en", "s", 1)]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), ""] for r in rows]
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    taught = collections.Counter(w for r, t in zip(rows, tokens, strict=True) if r[0] is not None and not out[r[0]] for w in t)
    n, v = sum(taught.values()), len(taught)
    want = sorted((str(r[0]), out[r[0]], len(t), sum(w in taught for w in t), n, round(sum(math.log10((taught[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    got = language_model.score(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = language_model.score(table(spark, rows).repartition(5)).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    by = {r.doc_id: r for r in got}
    assert by[200].score == by[201].score and by[200].n_tokens == 1
    common = language_model.score(table(spark, rows), held=F.col("doc_id") % 2 == 0).where("doc_id < 120 AND held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert -common[0] / common[1] < math.log10(12)  # of a handful of words, learned from the other half


def test_words_stand_in_contexts(spark):
    """Texts of the same words in another order score less."""
    rows = [(i, "one two three " * 8, "en", "s", 1) for i in range(40)]
    rows += [(100, "one two three one two three", "en", "s", 1), (101, "three two one three two one", "en", "s", 1)]
    held = F.col("doc_id") >= 100
    by = {r.doc_id: r for r in language_model.score(table(spark, rows), held=held).collect()}
    assert by[100].base_score == pytest.approx(by[101].base_score) and by[100].score > by[101].score + 5
    assert by[100].score / by[100].n_tokens > -0.4  # a word's place tells the next one


def test_pairs_dealt_by_both_words(spark, monkeypatch):
    """Parts of few tokens, and first words whose pairs are dealt over all parts, give the same scores; so do blocks of few documents."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{x}" for x in range(12)], range(1, 13), k=rng.randrange(1, 60))), "en", "s", 1) for i in range(150)]
    want = sorted((r.doc_id, round(r.score, 9)) for r in language_model.score(table(spark, rows)).collect())
    monkeypatch.setattr(language_model, "PART_TOKENS", 300)
    assert sorted((r.doc_id, round(r.score, 9)) for r in language_model.score(table(spark, rows)).collect()) == want
    monkeypatch.setattr(language_model, "FREQUENT", 100)
    assert sorted((r.doc_id, round(r.score, 9)) for r in language_model.score(table(spark, rows).repartition(7)).collect()) == want


def test_words_longer_than_a_slice(spark):
    """Words of which each fills a slice of a batch by itself, among short ones."""
    rows = [(i, f"{'xyz'[i % 3] * (700_000 + i)} short words {i}", "en", "s", 1) for i in range(6)]
    got = {r.doc_id: r for r in language_model.score(table(spark, rows), held=F.lit(False), rounds=2).collect()}
    again = {r.doc_id: r for r in language_model.score(table(spark, [*rows, (9, "q" * 700_001, "en", "s", 1)]), held=F.col("doc_id") == 9, rounds=2).collect()}
    assert all(got[i].n_tokens == got[i].n_known == 5 and again[i].base_score == got[i].base_score for i in range(6))
    assert again[9].n_tokens == 2 and again[9].n_known == 1 and again[9].score < -100_000


def test_scores_without_teachers(spark):
    empty = table(spark, [(1, "a b", "en", "s", 1)])
    assert language_model.score(empty.limit(0)).count() == 0
    (row,) = language_model.score(empty, held=F.lit(True)).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isfinite(row.score) and row.score < 0
    with pytest.raises(ValueError, match="letters"):
        language_model.score(empty, letters=1)
