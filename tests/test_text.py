"""Text rules on strings with known results."""

import hashlib
import json
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, value, f, *more):
    row = spark.createDataFrame([(value, *more)], "a string" + ", b string" * bool(more))
    return row.select(f(*(F.col(c) for c in row.columns)).alias("x")).first().x


CASES = [
    (T.collapse, "  a \t b\n", "a b"),
    (T.unescape, r"café\tx \"y\"", 'café\tx "y"'),
    (T.strip_accents, "Crème brûlée", "Creme brulee"),
    (T.ascii_only, "a é b", "a b"),
    (T.clean_name, "Red  Kettlé", "Red Kettle"),
    (T.clean_name, "http://x", None),
    (T.clean_name, "home", None),
    (T.clean_name, "abcd", None),
    (T.clean_description, "too short a text", None),
    (T.mask_letternumbers, "Dell x200 laptop 15.6 in 4GB, 3pcs", "Dell LETTERNUMBER laptop 15.6 in LETTERNUMBER, LETTERNUMBER"),
    (T.mask_numbers, "costs 15.6 or 7", "costs NUMBER or NUMBER"),
    (T.breadcrumb, "Home // Garden // Tools", "Home > Garden > Tools"),
    (T.breadcrumb, "http://x", ""),
    (lambda c: F.concat_ws("|", *T.letternumbers(c)), "x200, and 4GB 3pcs. plain 12.5", "LETTERNUMBER, and LETTERNUMBER LETTERNUMBER. plain 12.5|3"),
    (lambda c: F.concat_ws("|", *T.letternumbers(c)), "none", "none|0"),
    (T.mt_short_name, "Red-Kettle X200 12 1.7l", "red kettle LETTERNUMBER NUMBER NUMBER LETTERNUMBER"),
    (T.strip_accents, "Việt Nam", "Viet Nam"),
    (T.breadcrumb, "A » B", "A > B"),
    (T.category, "a%20b<br>\tc", "a b > c"),
    (T.parent_category, "Home > Tools", "Home"),
    (T.mt_name, "Kettle 1x", None),
    (T.mt_name, "Red kettle large 7l", "red kettle large LETTERNUMBER"),
    (T.mt_name_filter, "http://x", "EMPTY"),
    (T.mt_name_filter, "A to Kettle", "kettle"),
    (T.mt_category, "Home & Garden > Garden Tools", "home_garden garden_tools"),
    (T.strip_html, "<p>a&amp;b</p><script>x</script>", "a&b"),
    (lambda c: T.shorten(c, 20), "one two three four five", "one two three [...]"),
    (lambda c: T.first_sentences(c, 2), "a.b.c", "a. b"),
    (lambda c: T.first_words(c, 2), "a b c", "a b"),
    (T.lemma_of_last, "red kettles", "red kettle"),
    (T.label_words, "a>b_c", "a b c"),
    (T.host, "http://shop.example.com:80/p", "shop.example.com"),
    (T.punctuated, "<b>", ""),
    (T.percent_decode, "a+b%20c", "a+b c"),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_rules(spark, f, value, want):
    assert one(spark, value, f) == want


def test_lists(spark):
    assert one(spark, "A,B", T.category_parts) == ["A", "B"]
    assert one(spark, "NFL > Team > Team Hats", lambda c: T.cleaned_parts(T.category_parts(c))) == ["Hats"]
    assert one(spark, "Toys > Sale", lambda c: T.cleaned_parts(T.category_parts(c))) == ["Toys"]
    assert one(spark, "http://www.kettle-shop.com/red/kettle.html", T.url_words) == ["kettle-shop", "red", "kettle"]
    assert one(spark, "The Cats' naïve", T.analyzed) == ["the", "cats", "naive"]
    assert one(spark, "a b c", lambda c: T.prefix_ngrams(F.split(c, " "))) == [["a", "b"], ["a", "b", "c"]]
    assert one(spark, "dog", lambda c: T.with_synonyms(F.array(c), {"dog": ["hound"]})) == ["dog", "hound"]


def test_english_literals(spark):
    rows = spark.createDataFrame([("some text", "@en"), ("texte", "@fr"), ("short", ""), ("\\u0430" * 10 + "abc", ""), ("plain enough text", "")], "o string, tag string")
    assert [r.x for r in rows.select(T.english_literal(F.col("o"), F.col("tag")).alias("x")).collect()] == [True, False, True, False, True]


def test_jaccard_is_symmetric_and_bounded(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(st.text("abc d", min_size=1), st.text("abc d", min_size=1)), min_size=30, max_size=40))
    def check(pairs):
        rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.char_jaccard(F.col("a"), F.col("b")).alias("x"), T.char_jaccard(F.col("b"), F.col("a")).alias("y")).collect()
        for r in rows:
            assert r.x == r.y == pytest.approx(len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)))

    check()


@pytest.mark.parametrize(
    "value, want",
    [
        (r"pi\u00f1a \u00E9t\u00C9 gar\u00e7on\u2019s \u4e2d\u0416", "piña étÉ garçon’s 中Ж"),
        (r"\ud83d\ude00 \uD83D\uDE00", "😀 😀"),
        (r"\ud83d x \ude00\u00f1", r"\ud83d x \ude00ñ"),
        (r"C:\\new \\u00e9 \q \u12 \uu00f1" + "\\", r"C:\new \u00e9 \q \u12 ñ" + "\\"),
        ("a\\\nb\n", "a\\\nb\n"),
        ("", ""),
        (None, None),
    ],
)
def test_unescape_every_code(spark, value, want):
    assert one(spark, value, T.unescape) == want


def test_names_with_escapes(spark):
    assert one(spark, r"Jalape\u00f1o Sal\u00E7a", T.clean_name) == "Jalapeno Salca"
    assert one(spark, r"<p>Caf\u00e9 gar\u00e7on it\u2019s a pi\u00f1a</p>", T.full_description) == "caf garon its a pia"


def plain_description(text):
    """The rules on one text, with the escapes read by Python's JSON reader; null if it is none."""
    text = json.loads(f'"{text}"') if "\\" in text else text
    text = "".join(x for x in unicodedata.normalize("NFD", " ".join(text.split())) if x.isascii())
    text = re.sub(r"\s+", " ", text).strip()
    fine = len(text) >= 20 and len(text.split()) >= 10 and not text.startswith(".")
    return text if fine else None


def test_descriptions_with_backslashes(spark, tmp_path):
    from millrace.plans.queries import QUERIES

    words = "of a red kettle with lid for tea and more"
    texts = [words, rf"caf\u00e9 pi\u00F1a \u00e7 {words}", rf"C:\\temp\\new {words}", rf"\"one\"\ttwo\n{words}", rf"\u4e2d\u6587 {words}", r"\u0061 b", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.digest for r in QUERIES["clean_desc_filters"](spark, str(tmp_path)).collect()}
    want = {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(map(plain_description, texts)) if t}
    assert len(want) == 5 and got == want
