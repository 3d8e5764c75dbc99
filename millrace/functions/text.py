"""Text rules as Column functions: cleaning, masking, validity, similarity. All run inside Spark's generated code."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.constants import (
    BREADCRUMB_SEPARATORS,
    CATEGORY_PATH,
    CATEGORY_SIGNS,
    EMPTY_HEAD,
    EMPTY_NAMES,
    FOREIGN_SUFFIXES,
    HOST_SUFFIXES,
    LETTERNUMBER,
    MORE_STOP_WORDS,
    NO_CATEGORY,
    NUMBER,
    OFFER_OR_PRICE,
    PAGE_WORDS,
    STOP_WORDS,
)


def collapse(c: Column) -> Column:
    """Runs of blanks become one; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: A pair of surrogates, another code (a lone surrogate is none), any other escape, what stands between, a last backslash.
_CODE = r"\\u+(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
_PAIR = r"\\u+[dD][89abAB][0-9a-fA-F]{2}\\u+[dD][c-fC-F][0-9a-fA-F]{2}"
_PARTS = rf"(?s)({_PAIR}|{_CODE}|\\.|[^\\]+|\\)"


def unescape(c: Column) -> Column:
    r"""Backslash escapes \n \t \r \" \' \/ \\ and every \uXXXX from left to right, surrogate pairs as one character; what is malformed stays."""

    def plain(part: Column) -> Column:
        # the hex digits are UTF-16
        out = F.when(part.rlike(rf"^(?:{_PAIR}|{_CODE})$"), F.decode(F.unhex(F.regexp_replace(part, r"\\u+", "")), "UTF-16BE"))
        for mark, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\\/", "/"), ("\\\\", "\\")):
            out = out.when(part == mark, F.lit(char))
        return out.otherwise(part)

    return F.when(c.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PARTS), F.lit(1)), plain), "")).otherwise(c)


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and that letter."""
    pairs = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, *_accents()), "[̀-ͯ]", "")).otherwise(c)


def ascii_only(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def alphanumeric(c: Column, keep: str = "") -> Column:
    """Letters and digits, and the characters of `keep` (written for a character class); all else is a blank."""
    return collapse(F.regexp_replace(c, rf"[^\p{{IsAlphabetic}}\p{{IsDigit}}{keep}]", " "))


def punctuated(c: Column) -> Column:
    """Letters, digits and punctuation; a text that is one tag as a whole is empty."""
    kept = collapse(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{IsDigit}\p{Punct}]", " "))
    return F.when(collapse(c).rlike(r"^<[^<>]*>$"), F.lit("")).otherwise(kept)


#: A match begins where a run of letters, digits, commas and dots does; said first, this spares the look-ahead at all other places.
_LETTERNUMBER = r"(?<![A-Za-z\d,.])" + LETTERNUMBER


def mask_letternumbers(c: Column) -> Column:
    return F.regexp_replace(c, _LETTERNUMBER, "LETTERNUMBER")


def letternumbers(c: Column) -> tuple[Column, Column]:
    """The masked text and the number of masks, from one pass: what stands between the matches."""
    between = F.split(c, _LETTERNUMBER)
    return F.array_join(between, "LETTERNUMBER"), (F.size(between) - 1).cast("long")


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "NUMBER")


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    return F.split(c, r"\s+")


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+", "")


def word_characters(c: Column) -> Column:
    """Runs of what is no letter, digit or underscore (of any script) become one blank."""
    return F.regexp_replace(c, r"(?U)\W+", " ")


def normal_words(c: Column) -> Column:
    """Lower-case words of a text without its URLs; the array has an empty word where the text begins or ends with none."""
    return F.split(F.lower(without_urls(c)), r"(?U)\W+")


def letters_only(c: Column) -> Column:
    """Lower-case words of ASCII letters."""
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")


def stemmed(word: Column) -> Column:
    """Suffix rules for English nouns and verbs of four letters and more: our own, since no lemma data is at hand."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(F.length(word) < 4, word)
        .when(word.rlike("[^aeiou]ies$"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("(sh|ch|x|z|s)es$"), cut(2))
        .when(word.rlike("s$"), cut(1))
        .when(word.rlike("[a-z]{3}ing$"), cut(3))
        .when(word.rlike("[a-z]{3}ed$"), cut(2))
        .otherwise(word)
    )


def lemma_of_last(c: Column) -> Column:
    """The text with its last word as a stem."""
    words = F.split(c, " ")
    return F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(stemmed(F.element_at(words, -1)))), " ")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS, *MORE_STOP_WORDS))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two sets of characters."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def _ends(c: Column, suffixes: list[str]) -> Column:
    return c.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def valid_host(c: Column) -> Column:
    return _ends(c, HOST_SUFFIXES)


def foreign_host(c: Column) -> Column:
    return _ends(c, FOREIGN_SUFFIXES)


def url_of_id(c: Column) -> Column:
    """The page of an entity id subject|page."""
    return F.get(F.split(c, r"\|"), F.lit(1))


def basic_clean(c: Column) -> Column:
    return F.trim(strip_accents(collapse(unescape(c))))


def clean_name(c: Column) -> Column:
    """The ASCII form of a product name, or null if it is no name."""
    plain = ascii_only(strip_accents(collapse(unescape(F.trim(c)))))
    bad = F.trim(c).startswith("http") | F.lower(plain).isin(*EMPTY_NAMES["product"]) | (F.length(plain) < 5) | plain.startswith(".") | plain.startswith("\\u")
    return F.when(~bad, plain)


def clean_name_category(c: Column) -> Column:
    plain = ascii_only(strip_accents(collapse(unescape(c))))
    bad = F.lower(plain).isin(*EMPTY_NAMES["product"]) | (F.length(plain) < 3) | plain.startswith(".") | plain.startswith("\\u")
    return F.when(~bad, plain)


def clean_description(c: Column, least_chars: int = 20, least_tokens: int = 10) -> Column:
    plain = ascii_only(strip_accents(collapse(unescape(c))))
    bad = F.lower(plain).isin(*EMPTY_NAMES["product"]) | (F.length(plain) < least_chars) | (F.size(tokens(plain)) < least_tokens) | plain.startswith(".") | plain.startswith("\\u")
    return F.when(~bad, plain)


def differs(a: Column, b: Column) -> Column:
    return F.lower(a) != F.lower(b)


def large_enough(c: Column, chars: int, words: int) -> Column:
    """More than so many characters and tokens."""
    return (F.length(c) > chars) & (F.size(tokens(c)) > words)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def first_sentences(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, r"\."), 1, n), ". ")


def shorten(c: Column, most: int) -> Column:
    """At most `most` characters, cut between words, with " [...]" for what is left out."""
    whole, mark = collapse(c), " [...]"
    cut = F.regexp_extract(whole, rf"^(.{{0,{most - len(mark)}}})(?: |$)", 1)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit(mark)))


def english_literal(text: Column, tag: Column) -> Column:
    r"""By its language tag; without one, short texts and those of which more than half is left without \uXXXX."""
    rest = F.length(F.regexp_replace(text, r"\\u[0-9A-Fa-f]{4}", ""))
    return F.when(tag.startswith("@en"), True).when(tag.startswith("@"), False).when(F.length(text) < 10, True).otherwise(rest > F.length(text) / 2)


def numbers_in(plain: Column) -> Column:
    return count_matches(plain, NUMBER) + count_matches(plain, _LETTERNUMBER)


def dense_numbers(plain: Column) -> Column:
    """Numbers make up a third (whole division) of the tokens."""
    n = F.size(tokens(plain))
    return numbers_in(plain) >= F.floor(n / 3)


def dense_numbers_strict(plain: Column) -> Column:
    """Numbers make up more than a third of the tokens."""
    return numbers_in(plain) > F.size(tokens(plain)) / 3


def masked(plain: Column) -> Column:
    return mask_numbers(mask_letternumbers(plain))


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return collapse(c)


def full_description(c: Column, lower: bool = True) -> Column:
    """HTML to masked plain words; null if numbers are dense or there are fewer than 5 or more than 200 tokens."""
    text = unescape(strip_html(c))
    plain = alphanumeric(ascii_only(F.lower(text) if lower else text), ":,.;")
    n = F.size(tokens(plain))
    return F.when(~dense_numbers(plain) & n.between(5, 200), masked(plain))


def mt_name(c: Column) -> Column:
    plain = F.lower(alphanumeric(ascii_only(unescape(c))))
    clean = masked(plain)
    n = F.size(tokens(clean))
    bad = ~n.between(2, 10) | (numbers_in(plain) > n / 3) | F.arrays_overlap(tokens(clean), F.array(F.lit("http"), F.lit("https"), F.lit("www")))
    return F.when(~bad, clean)


def mt_short_name(c: Column) -> Column:
    """For translation input, second form: lower-case words, those of letters with digits and lone numbers masked."""
    plain = F.lower(collapse(word_characters(c)))
    return F.regexp_replace(F.regexp_replace(plain, r"[A-Za-z]+[\d@]+[\w@]*|[\d@]+[A-Za-z]+[\w@]*", "LETTERNUMBER"), r"(?<!\S)\d+(?!\S)", "NUMBER")


def mt_name_filter(c: Column) -> Column:
    """For translation input: masked words longer than two characters, EMPTY for URLs and for nothing."""
    clean = masked(alphanumeric(F.lower(c), ":,.;"))
    kept = F.array_join(F.filter(tokens(clean), lambda w: F.length(w) > 2), " ")
    return F.when(c.startswith("http") | (kept == ""), F.lit("EMPTY")).otherwise(kept)


def mt_category(c: Column) -> Column:
    """A category path as blank-separated elements with underscores inside, or null if it is none."""
    text = unescape(c)
    plain = F.lower(alphanumeric(F.regexp_replace(ascii_only(text), "set=", "/"), r"|>/"))
    clean = masked(plain)
    n = F.size(tokens(clean))
    bad = text.rlike("https?://") | ~n.between(2, 10) | (numbers_in(plain) > n / 3) | F.arrays_overlap(tokens(clean), F.array(F.lit("http"), F.lit("https"), F.lit("www"))) | (F.length(plain) < 3)
    parts = F.transform(F.split(clean, r"[|>/\-]+"), lambda p: F.lower(alphanumeric(p)))
    path = F.array_join(F.transform(F.filter(parts, lambda p: F.length(p) > 2), lambda p: F.replace(p, F.lit(" "), F.lit("_"))), " ")
    return F.when(~bad, path)


def percent_decode(c: Column) -> Column:
    """%XX decoded, plus signs kept; null where the encoding is broken."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def breadcrumb(c: Column) -> Column:
    """Breadcrumbs with " > " for the first separator that occurs; addresses and comments are empty."""
    text = F.trim(F.coalesce(percent_decode(c), c))
    out = F.when(F.lit(False), text)
    for sign, pattern in BREADCRUMB_SEPARATORS:
        out = out.when(text.contains(sign), F.regexp_replace(text, pattern, " > "))
    out = F.regexp_replace(out.otherwise(text), r"\s+>\s+>\s+", " > ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), CATEGORY_PATH, " > "))
    return F.when(no_category(c), F.lit("")).otherwise(out)


def no_category(c: Column) -> Column:
    return reduce(Column.__or__, (c.contains(sign) for sign in NO_CATEGORY))


def category(c: Column) -> Column:
    text = F.replace(F.coalesce(percent_decode(c), c), F.lit("<br>"), F.lit(""))
    for sign in CATEGORY_SIGNS:
        text = F.replace(text, F.lit(sign), F.lit(" > "))
    return F.trim(F.regexp_replace(text, CATEGORY_PATH, " > "))


def category_parts(c: Column) -> Column:
    return F.when(c.rlike(CATEGORY_PATH), F.split(c, CATEGORY_PATH)).when(c.rlike(r"[^\s],[^\s]"), F.split(c, ",")).otherwise(F.array(c))


def category_or_breadcrumb(cat: Column, crumb: Column) -> Column:
    return F.when((cat == "") | no_category(cat), crumb).otherwise(cat)


def parent_category(c: Column) -> Column:
    return F.trim(F.substring_index(c, ">", 1))


def cleaned_parts(parts: Column) -> Column:
    """Category elements without league or "College" heads, repeated heads and prices."""
    trimmed = F.transform(parts, lambda p: F.trim(p))
    tail = lambda a: F.when(F.size(a) > 1, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    headless = F.when(F.get(trimmed, F.lit(0)).rlike(EMPTY_HEAD), tail(trimmed)).otherwise(trimmed)
    head = F.get(headless, F.lit(0))
    again = F.exists(tail(headless), lambda p: p.contains(head))
    freed = F.transform(tail(headless), lambda p: F.when(p == head, p).otherwise(F.trim(F.replace(p, F.concat(head, F.lit(" ")), F.lit("")))))
    return F.filter(F.when(again, freed).otherwise(headless), lambda p: ~p.rlike(OFFER_OR_PRICE))


def label_words(c: Column) -> Column:
    return F.translate(c, ">_", "  ")


def url_words(url: Column, part: str = "both") -> Column:
    """Words of an address: the longest label of its host with more than three letters, and those of its path."""
    labels = F.filter(F.split(host(url), r"\."), lambda w: F.length(w) > 3)
    longest = F.get(F.array_sort(labels, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    of_host = F.when(longest.isNotNull(), F.array(longest)).otherwise(F.array().cast("array<string>"))
    path = F.split(F.lower(F.try_parse_url(url, F.lit("PATH"))), "[^a-z0-9]+")
    of_path = F.filter(path, lambda w: (F.length(w) >= 3) & ~w.isin(*PAGE_WORDS))
    return {"host": of_host, "path": of_path, "both": F.concat(of_host, of_path)}[part]


def analyzed(c: Column) -> Column:
    """Index terms: tokens of letters and digits, folded to ASCII, without stop words, lower-cased."""
    # letters with accents are letters without, so the text is folded as a whole before it is cut
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *_accents())).otherwise(c)
    words = F.regexp_extract_all(folded, F.lit(r"[\p{IsAlphabetic}\p{IsDigit}]+(?:'[\p{IsAlphabetic}\p{IsDigit}]+)*"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), F.lower)


def with_synonyms(words: Column, synonyms: dict[str, list[str]]) -> Column:
    """Query terms with their synonyms after each."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, [k, *v]))))) if synonyms else None
    return words if table is None else F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w))))


def prefix_ngrams(words: Column) -> Column:
    """All beginnings of two words and more."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(2), F.size(words)), lambda n: F.slice(words, 1, n))).otherwise(F.array().cast("array<array<string>>"))
