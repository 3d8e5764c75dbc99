"""FLAC, SentencePiece and language ID against plain versions and libraries."""

import os
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import flac, langid, pieces
from tests.conftest import DATA

MODEL = os.environ.get("MILLRACE_PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CLASH = ", media string, size int, ids string, begin string, lang_pred string"
AWKWARD = [(1, "plain words"), (2, None), (3, ""), (4, "é" * 300), (5, "plain words"), (5, "plain words"), (None, "  \n\t▁x𐍈"), (6, "long " * 9000)]


def table(spark, rows=AWKWARD):
    return spark.createDataFrame([(*r, "m", 1, "i", "b", "l") for r in rows], "doc_id long, text string" + CLASH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.text(max_size=300).map(str.encode), st.sampled_from([b"\xff\xf8\x10\x02" * 200, b" " * 500, bytes(range(256)) * 3, b"\x00\xff" * 300])), min_size=1, max_size=6))
def test_flac_is_lossless(contents):
    payloads = [flac.padded(c) for c in contents]
    media = flac.encode_payloads(payloads)
    assert flac.decode_media(media) == payloads
    assert media == [flac.encode_payloads([p])[0] for p in payloads]


def test_flac_finds_damage():
    media = bytearray(flac.encode_payloads([flac.padded(b"some text to be kept whole " * 30)])[0])
    for at in range(flac._info(bytes(media))[2][0][1], len(media), 97):
        broken = media.copy()
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode_media([bytes(broken)])


def test_flac_columns(spark):
    docs = table(spark)
    rows = flac.from_flac(flac.to_flac(docs))
    got = rows.collect()
    whole = lambda r: b"".join(bytes(b.pcm) for b in r.pcm)
    assert sorted(map(whole, got)) == sorted(flac.padded((t or "").encode()) for _, t in AWKWARD)
    for r in got:
        p = whole(r)
        assert r.tail_crc32 == zlib.crc32(p[-16:]) and r.payload_bytes == len(p) and r.n_bytes == len((r.text or "").encode())
        assert r.n_blocks == len(r.pcm) and [b.sample_offset for b in r.pcm] == list(range(0, len(p), 64 * 192))
        assert r.seek_offset == r.pcm[-1].sample_offset and r.seek_crc32 == zlib.crc32(p[r.seek_offset :])
    blocks = flac.pcm_blocks(rows.where("doc_id = 6")).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.padded(b"long " * 9000) and [b.block for b in blocks] == [0, 1, 2, 3]
    assert flac.from_flac(flac.to_flac(docs.limit(0))).count() == 0
    back = flac.from_pcm(flac.stored_pcm(rows))
    assert sorted(map(str, back.select(*(c for c in rows.columns if c != "pcm")).collect())) == sorted(map(str, rows.drop("pcm").collect()))
    moved = rows.withColumn("pcm", F.transform("pcm", lambda b: F.struct((b["sample_offset"] + 1).alias("sample_offset"), b["pcm"].alias("pcm"))))
    with pytest.raises(Exception, match="PCM blocks"):
        flac.from_pcm(moved).collect()
    assert flac.from_pcm(rows.limit(0)).count() == 0


def test_flac_seeks():
    payload = flac.padded(bytes(i * i % 251 for i in range(40_000)))
    media = flac.encode_payloads([payload])[0]
    for sample, count in ((0, 10), (12_287, 3), (12_288, 192), (30_001, 9_000), (0, len(payload)), (len(payload) - 1, 50), (len(payload), 5)):
        assert flac.seek(media, sample, count) == payload[sample : sample + count]
    # a damaged stretch is no hindrance to another
    broken = media[:-5] + bytes([media[-5] ^ 1]) + media[-4:]
    assert flac.seek(broken, 100, 300) == payload[100:400]
    with pytest.raises((ValueError, IndexError)):
        flac.seek(broken, len(payload) - 10, 10)


def scalar_decode(media: bytes) -> bytes:
    """A FLAC decoder bit by bit, for mono streams of 8 bits."""
    at = 4
    while True:
        last, n = media[at] & 128, int.from_bytes(media[at + 1 : at + 4], "big")
        if media[at] & 127 == 0:
            samples = int.from_bytes(media[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + n
        if last:
            break
    bits = "".join(f"{b:08b}" for b in media[at:])
    pos, out = 0, []

    def take(n: int, signed: bool = False) -> int:
        nonlocal pos
        v = int(bits[pos : pos + n] or "0", 2)
        pos += n
        return v - (1 << n) if signed and n and bits[pos - n] == "1" else v

    while len(out) < samples:
        assert take(15) == 0x7FFC and take(1) == 0
        size = take(4)
        take(12)
        lead = take(8)
        take(8 * max(0, f"{lead:08b}".index("0") - 1))
        block = take(8) + 1 if size == 6 else 192
        take(8)
        take(1)
        kind = take(6)
        take(1)
        if kind == 0:
            x = [take(8, True)] * block
        elif kind == 1:
            x = [take(8, True) for _ in range(block)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [take(8, True) for _ in range(order)]
            if kind >= 32:
                wide = take(4) + 1
                shift = take(5)
                coefs = [take(wide, True) for _ in range(order)]
            else:
                shift, coefs = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            method, parts = take(2), take(4)
            for part in range(1 << parts):
                k = take(4 + method)
                for _ in range((block >> parts) - (order if part == 0 else 0)):
                    q = 0
                    while not take(1):
                        q += 1
                    u = q << k | take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
        out += x
        pos += -pos % 8 + 16
    return bytes(v + 128 for v in out)


def by_hand(frames: list[tuple[int, list[int], int, list[int], int]], x: list[int]) -> bytes:
    """A stream without seek table: per frame the kind of subframe, the LPC coefficients, their shift, Rice parameters by partition, their method."""
    import hashlib

    body = b""
    for number, (kind, coefs, shift, ks, method) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x10, 0x02, number])
        head += bytes([crc(head, 8, 0x07)])
        block = x[number * 192 : number * 192 + 192]
        order = kind - 31 if kind >= 32 else kind - 8
        use = coefs if kind >= 32 else [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        bits = f"0{kind:06b}0" + "".join(f"{v & 255:08b}" for v in block[:order])
        if kind >= 32:
            bits += f"{11:04b}{shift:05b}" + "".join(f"{c & 4095:012b}" for c in coefs)
        bits += f"{method:02b}{len(ks).bit_length() - 1:04b}"
        each = 192 // len(ks)
        for p, k in enumerate(ks):
            bits += f"{k:0{4 + method}b}"
            for t in range(max(order, p * each), (p + 1) * each):
                e = block[t] - (sum(c * block[t - 1 - j] for j, c in enumerate(use)) >> (shift if kind >= 32 else 0))
                u = 2 * e if e >= 0 else -2 * e - 1
                bits += "0" * (u >> k) + "1" + (f"{u & (1 << k) - 1:0{k}b}" if k else "")
        bits += "0" * (-len(bits) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        body += frame + crc(frame, 16, 0x8005).to_bytes(2, "big")
    info = bytes([0, 192, 0, 192, 0, 0, 0, 0, 0, 0]) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in x)).digest()
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + body


def crc(data: bytes, width: int, poly: int) -> int:
    value = 0
    for byte in data:
        value ^= byte << width - 8
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> width - 1 else 0)) & (1 << width) - 1
    return value


def test_flac_and_a_scalar_decoder_agree():
    """Our streams by another decoder, and hand-made ones, with predictors and partitions that our writer does not use, by ours."""
    contents = [b"some text, some more text and so on. " * 60, bytes(range(256)) * 4, b"\x00\xff" * 300, b"a" * 400, b""]
    payloads = [flac.padded(c) for c in contents]
    for payload, media in zip(payloads, flac.encode_payloads(payloads), strict=True):
        assert scalar_decode(media) == payload
    x = [int(60 * np.sin(i / 9) + 20 * np.sin(i / 2.3)) + i % 3 for i in range(192 * 6)]
    media = by_hand([(8, [], 0, [6], 0), (9, [], 0, [5, 4], 0), (11, [], 0, [4, 5, 4, 5], 0), (12, [], 0, [6] * 8, 1), (32 + 2, [1800, -900, 100], 10, [4, 4], 0), (32 + 7, [900, 40, -30, 20, 10, 5, -60, 7], 10, [6], 1)], x)
    want = bytes(v + 128 for v in x)
    assert scalar_decode(media) == want
    assert flac.decode_media([media]) == [want] and flac.seek(media, 500, 100) == want[500:600]


@pytest.fixture(scope="module")
def known():
    with open(MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


@lru_cache
def unigram_models():
    """Ours and the public library's reading of the same serialised unigram model."""
    import sentencepiece

    with open(MODEL, "rb") as file:
        proto = pieces.unigram(file.read())
    return pieces.Vocabulary(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeth ing.,\n▁é𐍈Z09'"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_encoding_equals_the_library(texts):
    import sentencepiece

    with open(MODEL, "rb") as file:
        known = pieces.vocabulary(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for known, library in ((known, library), unigram_models()):
        got = [np.frombuffer(b, np.int32).tolist() for b in known.encode(texts)]
        assert got == library.encode(texts)
        assert [known.decode(ids) for ids in got] == [t.replace(pieces.MARK, " ") for t in texts]


def test_decoding_by_gathering_is_decoding():
    """Lists of any ids, with nulls, empty ones, slices, and bytes that are sound only across two lists."""
    import pyarrow as pa

    known, _ = unigram_models()
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, len(known.raw), n).tolist() for n in (0, 1, 5, 300, 0, 2)]
    texts = [np.frombuffer(b, np.int32).tolist() for b in known.encode(["a é text", "", " x", "𐍈 ok"])]
    split = [[known.bytes[0xC3]], [known.bytes[0xA9]]] if known.bytes else []
    for some in (lists, texts, [None, *texts, None], split + texts, [[]], []):
        ids = pa.array(some, pa.list_(pa.int32()))
        want = [None if x is None else known.decode(x) for x in some]
        assert known.decode_all(ids).to_pylist() == want
        if len(some) > 2:
            assert known.decode_all(ids.slice(1, 2)).to_pylist() == want[1:3]


def test_viterbi_of_driver_rows_equals_the_library():
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/sf0.001/documents.parquet' WHERE length(text) < 20000").fetchall() if t]
    known, library = unigram_models()
    assert [np.frombuffer(b, np.int32).tolist() for b in known.encode(texts)] == library.encode(texts)
    assert len(texts) > 150


def test_unigram_forward_pass_is_viterbi(known):
    model = pieces.Vocabulary(b"\x1a\x02\x20\x00")  # a normalizer that keeps extra blanks
    model.unigram = True
    model.score = {p: -float(len(p) % 3) - i * 0.01 for i, p in enumerate(["a", "b", "ab", "ba", "aba", "abab", "bb", "bbaab"])}
    model.id = {p: i for i, p in enumerate(model.score)}
    model.lowest = -20.0
    model.lengths = {"abab": [4, 3, 2], "baab": [5, 3, 2]}

    def best(word):
        top = [(0.0, ())]
        for end in range(1, len(word) + 1):
            top.append(max((top[b][0] + model.score.get(word[b:end], model.lowest if end - b == 1 else -1e9), (*top[b][1], word[b:end])) for b in range(end)))
        return top[-1][0]

    words = sorted({format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in range(1, 9) for i in range(1 << n)} | {"acab", "cc"})
    for word, tokens in model.segment(words):
        assert "".join(tokens) == word and sum(model.score.get(t, model.lowest) for t in tokens) == pytest.approx(best(word))


def test_piece_columns(spark):
    docs = table(spark)
    for kind in ("file", "unigram"):
        got = pieces.decode(pieces.encode(docs, MODEL, kind=kind), MODEL, most=1000).collect()
        assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), (t or "").replace(pieces.MARK, " ")) for i, t in AWKWARD)
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), (t or "").replace(pieces.MARK, " ")) for i, t in AWKWARD)
    assert all((len(r.ids) == 0) == (not r.text) for r in got)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def brute_phrases(coded: bytes, sample: bytes) -> int:
    count = at = 0
    while at < len(coded):
        end = at
        while end < len(coded) and coded[at : end + 1] in sample:
            end += 1
        count, at = count + 1, max(end, at + 1)
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab cé!", max_size=60), min_size=1, max_size=5), st.text(alphabet="ab c", min_size=1, max_size=80), st.text(alphabet="aé", min_size=1, max_size=80))
def test_phrases_are_longest_matches(texts, one, two):
    samples = tuple((name, langid.symbols([t], "abc")[0].tobytes()) for name, t in (("x", one), ("y", two)))
    coded, begins = langid.symbols(texts, "abc")
    cut, window = langid.STRETCH, langid.WINDOW
    got = []
    try:
        for langid.STRETCH, langid.WINDOW in ((cut, window), (3, window), (5, 11)):
            got.append(langid.phrases(coded, begins, ("abc", samples)).tolist())
    finally:
        langid.STRETCH, langid.WINDOW = cut, window
    want = [[brute_phrases(coded[a:b].tobytes(), s) for a, b in zip(begins[:-1], begins[1:], strict=True)] for _, s in samples]
    assert got == [want] * 3


@pytest.mark.parametrize("size", [1025, 5_000, 100_000])
def test_phrases_of_long_texts(size):
    """No restart inside a text: words in any order, a text that its sample holds whole, and one letter over and over."""
    rng = np.random.default_rng(size)
    sample = " ".join(rng.choice(["abc", "acb", "bca", "c", "ab"], 900).tolist())
    texts = [" ".join(rng.choice(["abc", "bca", "cab", "aa"], size // 3).tolist())[:size], (sample * (size // len(sample) + 1))[:size], "a" * size, "ab"]
    samples = tuple((name, langid.symbols([t], "abc")[0].tobytes()) for name, t in (("x", sample), ("y", "a" * 2000)))
    coded, begins = langid.symbols(texts, "abc")
    want = [[brute_phrases(coded[a:b].tobytes(), s) for a, b in zip(begins[:-1], begins[1:], strict=True)] for _, s in samples]
    assert langid.phrases(coded, begins, ("abc", samples)).tolist() == want


def test_predictions_have_the_fewest_phrases(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    letters, samples = langid.fit(docs.where(~langid.held_out()))
    rows = docs.orderBy(F.abs(F.length("text") - 3000)).limit(40).collect()
    names, scores = langid.predict([r.text for r in rows], (letters, samples))
    for r, name, score in zip(rows, names, scores, strict=True):
        coded = langid.symbols([r.text], letters)[0].tobytes()
        rate = sorted((brute_phrases(coded, s) * np.log2(len(s) + 1) / len(coded), lang) for lang, s in samples)
        assert name == rate[0][1] and score == pytest.approx(1 - rate[0][0] / rate[1][0])


def test_language_columns(spark):
    rows = [(i, t, lang, "l") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the end", None), (None, "en"), ("123 !!", "de"), ("", None), ("the dog and the cat " * 600, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()}
    assert [got[i][0] for i in range(7)] == ["en", "de", "en", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.identify(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(docs, max_langs=1, docs_per_lang=1)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    model = langid.fit(docs.where(~langid.held_out()))
    rows = langid.identify(docs.where(langid.held_out()), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
