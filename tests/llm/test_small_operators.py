"""Licences, WARC, mixing, chat, line and exact deduplication on small tables with every awkward row."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, licenses, line_dedup, mixing, ngram_join, warc
from tests.conftest import DATA

CLASH = ", size int, hash string, words string, n string, key string, template string"


def clashing(spark, rows, schema):
    """Rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "h", "w", "n", "k", "t") for r in rows], schema + CLASH)


LICENSED = [
    (1, "Under the MIT License. also under-the mit license"),
    (2, "apache license version"),
    (3, "CC BY NC cc by nc apache License, Version 2"),
    (4, None),
    (5, ""),
    (6, "x"),
    (6, "x"),
    (7, "Permission is hereby granted, totally free of charge, to any person obtaining a copy of this software and its associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    (None, "cc  by\nnc"),
    (8, "word " * 5000 + "cc by nc"),
    (9, "é CC BY NC É"),
]


def test_license_scan(spark):
    docs = clashing(spark, LICENSED, "doc_id long, text string")
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(LICENSED)
    lower = str.maketrans(licenses.CAPITALS, licenses.SMALL)
    want = []
    for i, text in LICENSED:
        words = re.findall(licenses.WORD, (text or "").translate(lower))
        places = [(p, label) for label, phrase in licenses.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r[:6]) for r in got], key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].labels == "mit" and by_id[7].base_labels == "" and 0.8 <= by_id[7].score < 1
    assert by_id[1].score == 1 and by_id[4].score == 0
    assert licenses.license_scan(docs.limit(0)).count() == 0


def plain_scan(text, k=3, slack=8, coverage=0.8):
    """Diagonal voting with loops: (n_words, n_base, first, last, base labels, labels, score)."""
    cut = lambda t: re.findall(licenses.WORD, (t or "").translate(str.maketrans(licenses.CAPITALS, licenses.SMALL)))
    words, base, labels, score = cut(text), [], set(), 0.0
    grams = {}
    for i in range(len(words) - k + 1):
        grams.setdefault(tuple(words[i : i + k]), []).append(i)
    for label, body, whole in [(*x, True) for x in licenses.PHRASES] + [(*x, False) for x in licenses.PASSAGES]:
        t = cut(body)
        n, diagonals = len(t) - k + 1, {}
        for p in range(n):
            for i in grams.get(tuple(t[p : p + k]), ()):
                diagonals.setdefault(i - p, set()).add(p)
        if whole:
            base += [(d, label) for d, seen in diagonals.items() if len(seen) == n]
            continue
        runs = []
        for d in sorted(diagonals):
            if runs and d - runs[-1][-1] <= slack:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            share = len(set().union(*(diagonals[d] for d in run))) / n
            begin, end = min(d + min(diagonals[d]) for d in run), max(d + max(diagonals[d]) for d in run) + k - 1
            score = max(score, share)
            if share >= coverage and end - begin + 1 <= len(t) * 2 + slack:
                labels.add(label)
    starts, own = [d for d, _ in base], {label for _, label in base}
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels | own)), 1.0 if base else score


def test_license_scan_equals_plain_voting(spark):
    """The driver's documents, and passages with words changed, left out, put in and moved."""
    draw = random.Random(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text").collect()]
    for i in range(60):
        words = draw.choice(licenses.PASSAGES)[1].split()
        for _ in range(draw.randrange(9)):
            at = draw.randrange(len(words))
            words[at : at + draw.choice([0, 1, 1, 2])] = draw.choice([[], ["other"], ["put", "in"] * draw.choice([1, 6])])
        if i % 5 == 0:
            words = words[len(words) // 2 :] + ["between"] * draw.choice([0, 30]) + words[: len(words) // 2]
        docs.append((10_000_000 + i, " ".join([*("before " * draw.randrange(5)).split(), *words, "under the MIT license" * (i % 7 == 0)])))
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        want = plain_scan(text)
        assert got[i][:6] == want[:6] and got[i][6] == pytest.approx(want[6])
    with pytest.raises(ValueError):
        licenses.license_scan(spark.createDataFrame(docs[:1], "doc_id long, text string"), phrases=(("x", "two words"),))


def test_warc_round_trip(spark, tmp_path):
    big = "".join(chr(random.Random(3).randrange(32, 0x2000)) for _ in range(30000))
    rows = [(i, f"http://a/{i}\r\n%", text) for i, text in enumerate([big, big, "short", "short", None, "", "x" * 100, "x" * 100, "x" * 99, "x" * 99, "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50])] + [(None, None, "y" * 200), (20, None, "y" * 200)]
    pages = spark.createDataFrame([(*r, "p", "d") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(warc.roles(pages), path)
    for split in (700, 1 << 20):
        back = {r.page_id: r for r in warc.read_warc(spark, path, split).collect()}
        assert len(back) == len(rows)
        assert [(back[i].record_type, back[i].refers_to) for i in (0, 1, 2, 3, 6, 7, 9)] == [("response", None), ("revisit", 0), ("response", None), ("response", None), ("response", None), ("revisit", 6), ("response", None)]
        for i, url, text in rows:
            data = (text or "").encode()
            r = back[i]
            assert (r.payload_bytes, r.payload_digest, r.url) == (len(data), hashlib.sha256(data).hexdigest(), url)
            assert r.payload == (None if r.record_type == "revisit" else data)
    empty = str(tmp_path / "e")
    warc.write_warc(warc.roles(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_records_are_owned_once_and_broken_bytes_are_skipped():
    member = lambda b: zlib.compressobj(1, zlib.DEFLATED, 31)
    records = [b"WARC/1.1\r\n" + bytes([i]) * (i * 37) for i in range(40)]
    packed = b"junk\x1f\x8b\x08\x00" + b"".join((z := member(r)).compress(r) + z.flush() for r in records) + b"\x1f\x8b\x08\x00\x00"
    read = lambda at, n: packed[at : at + n]
    for split in (1, 7, 64, 1000, len(packed)):
        got = [r for b in range(0, len(packed), split) for r in warc.records_in(read, b, min(b + split, len(packed)), len(packed), chunk=50)]
        assert got == records


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), s) for s in ("a", "b", "é", None) for i in range(60)] + [(None, None, "z"), (1, "", "z"), (5, "t\x0bt", "a"), (5, "t\x0bt", "a")]
    docs = clashing(spark, rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.TOKEN, text or ""))
    left, targets = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2), strict=True)), {}
    budget = 1.5 * sum(sizes.values())
    while left:  # the rule as it is told: share, cut, share again
        level = (budget - sum(targets.values())) / sum(left.values())
        over = [s for s, w in left.items() if w * level > 2 * sizes[s]]
        if not over:
            targets |= {s: w * level for s, w in left.items()}
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            del left[s]
    for r in plan:
        assert r.target == pytest.approx(targets[r.row.source], abs=1e-5) and 0 <= r.copies <= 2
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 300, "ann", None), (2, 0, "system", "x"), (None, 0, None, "q"), (3, 1, "ann", "b"), (3, 1, "ann", "a"), (3, 1, "ann", "a")]
    docs = clashing(spark, rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(docs).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo é<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hi", ""]
    assert [got[1, "bob", 0].text[s.start : s.end] for s in got[1, "bob", 0].spans] == ["yo é"]
    assert [got[3, "ann", 0].text[s.start : s.end] for s in got[3, "ann", 0].spans] == ["a", "a", "b"] and got[3, "ann", 0].n_turns == 3
    assert chat.perspectives(docs.limit(0)).count() == 0


def test_bounds_are_checked(spark):
    """What is broadcast or seen by one task has a stated size."""
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="32 MB"):
        licenses.license_scan(docs, passages=[("long", "word " * 500_000)])
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixing.source_targets(docs.select("source", docs.doc_id.alias("size")), most_sources=1)


def test_a_long_chat_is_whole(spark):
    """5,000 turns of three speakers, and as many without a conversation."""
    said = [(c, i, ["ann", "bob", "eve"][i * i % 3], f"{i} é" * (i % 4)) for c in (1, None) for i in range(5000)]
    docs = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.perspectives(docs).collect()
    assert sorted((str(r.conv_id), r.perspective, r.part, r.n_turns) for r in got) == sorted((c, who, 0, 5000) for c in ("1", "None") for who in {s[2] for s in said})
    for r in got:
        mine = [s for s in said if s[0] == r.conv_id]
        assert r.text == "".join(f"<|im_start|>{'assistant' if who == r.perspective else 'user name=' + who}\n{text}<|im_end|>\n" for _, _, who, text in mine)
        assert [r.text[s.start : s.end] for s in r.spans] == [text for _, _, who, text in mine if who == r.perspective]


def test_chat_parts_join_to_the_whole(spark):
    """Endless conversations with null, repeated and missing turn numbers, one with a null id, cut into parts of 7 rows."""
    draw = random.Random(3)
    rows = [(draw.choice([None, None, 1, 2]), draw.choice([None, 1, 1, *range(40)]), draw.choice(["a", "b", None, "system"]), f"t{draw.randrange(9)}" * draw.choice([1, 1, 5000])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    whole = {(r.conv_id, r.perspective): r for r in chat.perspectives(docs).collect()}
    parts = chat.perspectives(docs, part_turns=7).orderBy("part").collect()
    assert {(r.conv_id, r.perspective) for r in parts} == set(whole) and max(r.n_turns for r in parts) == 7
    for key, r in whole.items():
        mine = [p for p in parts if (p.conv_id, p.perspective) == key]
        assert [p.part for p in mine] == list(range(len(mine))) and "".join(p.text for p in mine) == r.text
        assert [p.text[s.start : s.end] for p in mine for s in p.spans] == [r.text[s.start : s.end] for s in r.spans]
        turns = sorted(((t is not None, t or 0, role or "unknown", text) for c, t, role, text in rows if c == key[0]))
        want = "".join(f"<|im_start|>{'system' if role == 'system' else 'assistant' if role == key[1] else f'user name={role}'}\n{text}<|im_end|>\n" for _, _, role, text in turns)
        assert r.text == want


def test_line_dedup(spark):
    fox = "the quick brown fox jumps over the lazy {} and runs away now friend"
    rows = [
        (1, "a b c d\nhello world is fine today ok\nuser 17 logged in from host 8"),
        (2, "a b c d\nx"),
        (3, f"user 99 logged in from host 10\nq w e r t\n\n{fox.format('dog')}"),
        (4, f"{fox.format('cat')}\nlast one here too x\nyes"),
        (5, None),
        (None, "a b c d"),
        (6, ""),
        (7, "yes\nyes"),
        (8, "a  b c\td"),
        (8, "a  b c\td"),
        (9, "same same same same\nsame same same same"),
    ]
    docs = clashing(spark, rows, "doc_id long, text string")
    out = line_dedup.line_dedup(docs, min_tokens=4)
    assert out.columns == [*docs.columns, "dropped_lines"]
    got = sorted(((r.doc_id, r.text, r.dropped_lines) for r in out.collect()), key=str)
    want = [(i, t, 0) for i, t in rows]
    want[1], want[2], want[3] = (2, "x", 1), (3, f"q w e r t\n\n{fox.format('dog')}", 1), (4, "last one here too x\nyes", 1)
    want[8] = want[9] = (8, "", 1)
    assert got == sorted(want, key=str)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    more = line_dedup.line_dedup(docs, min_docs=3, min_tokens=4)
    assert {r.doc_id: r.dropped_lines for r in more.where("doc_id IS NOT NULL").collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1, 9: 0}


def plain_line_dedup(rows, depth=3, similarity=0.8, min_docs=2, min_tokens=1):
    """Line by line through the tree: a line joins the first template that it agrees with, or becomes one."""
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())
    fits = lambda m: m and len(m.split()) >= min_tokens
    having, leaves, template = {}, {}, {}
    for i, text in rows:
        for m in filter(fits, map(mask, text.split("\n"))):
            having.setdefault(m, set()).add(i)
    for m in sorted(having, key=lambda m: (min(having[m]), line_dedup.line_key(m))):
        a = m.split()
        leaf = leaves.setdefault((len(a), *a[:depth]), [])
        template[m] = next((t for t in leaf if sum(x == y for x, y in zip(a, t.split(), strict=True)) / len(a) >= similarity), m)
        if template[m] == m:
            leaf.append(m)
    known = {}
    for m, t in template.items():
        docs = having[m] | having[t] if min_docs <= 2 else set().union(*(having[o] for o, of in template.items() if of == t))
        if len(docs) >= min_docs:
            known[m] = min(docs)
    return {i: "\n".join(line for line in text.split("\n") if known.get(mask(line), i) == i) for i, text in rows}


def test_a_line_goes_only_for_one_that_stays(spark):
    """The line of 2 agrees with that of 1, the line of 3 with that of 2 alone; and a longer chain, whole and in chunks."""
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h x y"), (3, "a b c d e f z w x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == {1: rows[0][1], 2: "", 3: rows[2][1]}
    words = list("abcdefghij")
    chain = []
    for i in range(40):
        words[3 + i % 7] = f"w{'xyz'[i % 3]}{chr(97 + i // 7)}"
        chain.append((i, " ".join(words)))
    assert 0 < sum(not t for t in plain_line_dedup(chain).values()) < 39
    for most in (1000, 4):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(line_dedup, "MOST_LINES", most)
            assert {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(chain, "doc_id long, text string")).collect()} == plain_line_dedup(chain)


def test_names_inside_do_not_clash(spark):
    """Columns called as those that operators join with, in either case."""
    rows = [(i, "one line here\nand another one", *range(9)) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, id long, _ID long, __gone long, gone long, mark long, __mark long, sha long, __block long")
    assert {r.doc_id: (r.text, r["__id"], r["id"], r["gone"]) for r in line_dedup.line_dedup(docs).collect()} == {1: (rows[0][1], 0, 1, 4), 2: ("", 0, 1, 4)}
    assert [tuple(r) for r in ngram_join.one_of_each(docs, words=2, percent=80).collect()] == [rows[0]]
    assert [tuple(r) for r in exact_dedup.survivors(docs).collect()] == [rows[1]]


def test_line_dedup_of_many_templates(spark):
    """Short variable lines, several templates to a leaf, long lines and unrelated lines of the same opening."""
    draw = random.Random(5)
    names = ["Anna", "Boris", "Carla", "Dmitri", "Edith", "Farid", "Greta"]
    forms = ["Order was shipped to {}", "Order was shipped by {}", "Read more", "All rights reserved."]
    forms += [f"we found that {w} was at the {v} on {{}} and then it left {{}}" for w, v in [("he", "bank"), ("she", "mill"), ("it", "farm"), ("who", "lake")]]
    forms += [f"we found that {' '.join(f'{w}{c}' for c in 'abcdefghijklmn')} {{}} and {{}} or {{}} so {{}}" for w in ("u", "v", "w", "x")]
    rows = []
    for i in range(60):
        lines = [draw.choice(forms).format(*draw.choices(names, k=4)) for _ in range(3)]
        lines += ["we found that " + " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([2, 3, 10, 19]))), ""]
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for settings in ({}, {"min_docs": 3}, {"similarity": 0.6}, {"min_docs": 4, "similarity": 0.7}):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, **settings).collect()}
        assert got == plain_line_dedup(rows, **settings)


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (3, "b"), (4, None), (9, ""), (None, "b"), (None, "c"), (7, "d"), (7, "d"), (8, "x" * 200_000), (6, "x" * 200_000)]
    docs = clashing(spark, rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([5, 3, 9, None, 7, 7, 8], key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [300, 2000, 1 << 20])
def test_grace_spills_and_compares_contents(limit):
    draw = random.Random(limit)
    records = []
    for i in range(600):
        content = b"%d" % draw.randrange(150) * draw.randrange(1, 3)
        digest = hashlib.sha256(content).digest() if draw.random() < 2 else b""
        records.append((digest[:1] * 32, content, i, 1))  # many equal digests: only contents tell apart
    got = {e[1]: (e[2], e[3]) for e in exact_dedup.grace(iter(records), limit)}
    want = {}
    for _, content, i, n in records:
        largest, rows = want.get(content, (0, 0))
        want[content] = max(largest, i), rows + n
    assert got == want


def test_line_dedup_query_drops_short_lines(spark, tmp_path):
    from millrace.llm.queries import op9_line_dedup

    rows = [(1, "Read more\nOrder was shipped to Anna\n\nyes"), (2, "Read more\n\nOrder was shipped to Boris\nno"), (3, "All rights reserved.\nyes\n\nOrder went to him")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.dropped_lines) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nno", 2), 3: ("All rights reserved.\n\nOrder went to him", 1)}


def test_line_dedup_is_the_same_by_blocks_and_chunks(spark, monkeypatch):
    """Leaves and blocks of more lines than one task compares, on the driver's own documents and on lines of one template."""
    draw = random.Random(8)
    rows = [(i, "\n".join(f"one two three four {draw.choice('abcdefghij')} {draw.choice('klmnop')} {draw.choice('uvwxyz')} eight nine {draw.choice('qr')}" for _ in range(4))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (1000, 5, 2):
        monkeypatch.setattr(line_dedup, "MOST_LINES", most)
        for settings in ({}, {"min_docs": 3}, {"similarity": 0.7}):
            got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, **settings).collect()}
            assert got == plain_line_dedup(rows, **settings)


def test_line_dedup_of_driver_rows(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).where("text IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == plain_line_dedup(rows)


def test_line_dedup_of_long_texts(spark):
    long = "\n".join(f"line {w} of many words" for w in ("ab " * 9000).split()) + "\n" + "w" * 300_000 + "\n" + "x y " * 100_000
    rows = [(1, long), (2, long), (3, "w" * 300_000)]
    got = {r.doc_id: (r.text, r.dropped_lines) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (long, 0), 2: ("", 9002), 3: ("", 1)}
