"""Multilingual text cleaning as Column expressions, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------------------
# The character classes and patterns of the cleaning rules.
CHINESE = r"[一-鿿㐀-䶿豈-﫿]"
LOWER_CAMEL = r"([a-z])([A-Z])"
CAPITAL = r"[A-ZА-ЯЁ]"
CAPITAL_RUN = r"([A-ZА-ЯЁ][^A-ZА-ЯЁ]*)"
NUMBER = r"(\d+(?:\.\d+)?)"
SPECIALS = r"""-)(][.,;:_/\|+*&^%$#@!~`"'<>?{}"""
WHITESPACE = r"\s+"
# --------------------------------------------------------------------------------------

#: Code point ranges of CHINESE; a reading table is one array over them, in this order.
_BLOCKS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF))

#: Java needs (?U) for ``\d`` and ``\s`` to mean Unicode digits and Unicode white space.
_UNICODE = "(?U)"
_ESCAPED = "".join("\\" + c for c in SPECIALS)
_SPECIAL_CLASS = f"[{_ESCAPED}\\n\\t]"
#: Where a word breaks: before a capital, before the first digit of a run and after its last.
_BREAK = _UNICODE + rf"({CAPITAL}|(?<!\d)\d|(?<=\d)\D)"
_GAP = _UNICODE + rf"[{_ESCAPED}\s]+"
#: One Chinese character, or a run of anything else.
_CHINESE_OR_RUN = f"({CHINESE}|[^{CHINESE[1:]}+)"
#: Title-case words: letters and numbers of any script; everything else separates.
_WORD_OR_GAP = r"([\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+)"
#: What makes initcap() differ from the title rule: characters other than these, a letter after a digit.
_PLAIN = "".join(chr(c) for low, high in ("AZ", "az", "АЯ", "ая", "ЁЁ", "ёё", "09", "  ") for c in range(ord(low), ord(high) + 1))
_LETTER_AFTER_DIGIT = r"[0-9][A-Za-zА-Яа-яЁё]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands in the plan and is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def has_chinese(col: Column) -> Column:
    return F.coalesce(col.rlike(CHINESE), F.lit(False))


def reading_table(readings: Mapping[str, str]) -> Column:
    """Array literal with one reading per code point of the three blocks ('' where none is known).

    The blocks hold 28 096 code points, so the literal is bounded whatever the data size.
    It is written as one split() of a constant, which the optimizer folds to an array.
    """
    points = [chr(p) for low, high in _BLOCKS for p in range(low, high + 1)]
    return F.split(F.lit(",".join(readings.get(c, "") for c in points)), ",")


def pinyin_readings(spark: SparkSession) -> dict[str, str]:
    """Toneless reading per Chinese character, from the public Unicode Han-Latin rules that ship
    with Spark's ICU library. ``ü`` is spelled ``v``, as is usual in toneless pinyin."""
    points = [chr(p) for low, high in _BLOCKS for p in range(low, high + 1)]
    tones = "[\\u0300-\\u0304 \\u0306 \\u030C] Remove"
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(f"Han-Latin; Lower; NFD; {tones}; NFC")
    latin = icu.transliterate("\n".join(points)).replace("ü", "v").split("\n")
    return {char: reading for char, reading in zip(points, latin, strict=True) if reading.isascii()}


def transliterate(col: Column, readings: Column) -> Column:
    """Replace every Chinese character by its reading, joined without separator.

    ``readings`` comes from :func:`reading_table`. Text without Chinese passes through after one
    regex test; a character's reading is an array access by code point, not a map scan.
    """

    def read(piece: Column) -> Column:
        point = F.ascii(piece)
        index = F.lit(None).cast("int")
        start = 0
        for low, high in _BLOCKS:
            index = F.when(point.between(low, high), point - (low - start - 1)).otherwise(index)
            start += high - low + 1
        return bind(F.get(readings, index - 1), lambda reading: F.when(F.length(reading) > 0, reading).otherwise(piece))

    pieces = F.regexp_extract_all(col, F.lit(_CHINESE_OR_RUN), F.lit(1))
    latin = F.array_join(F.transform(pieces, read), "")
    return F.when(has_chinese(col), latin).otherwise(col)


def split_lower_camel(col: Column) -> Column:
    return F.regexp_replace(col, LOWER_CAMEL, "$1 $2")


def split_capitals(col: Column) -> Column:
    return F.regexp_replace(col, CAPITAL_RUN, " $1")


def pad_numbers(col: Column) -> Column:
    return F.regexp_replace(col, _UNICODE + NUMBER, " $1 ")


def strip_specials(col: Column) -> Column:
    return F.regexp_replace(col, _SPECIAL_CLASS, " ")


def squeeze_ws(col: Column) -> Column:
    return F.regexp_replace(col, _UNICODE + WHITESPACE, " ")


def trim_text(col: Column) -> Column:
    """Trim spaces; run after :func:`squeeze_ws`, which leaves no other white space."""
    return F.trim(col)


def has_other(col: Column) -> Column:
    """Whether a text has characters that are not plain. Deleting the plain ones is one table access each; a search for
    a negated class of these ranges takes some ten times as long."""
    return F.translate(col, _PLAIN, "") != ""


def title_case(col: Column, apart: bool = False) -> Column:
    """First character of every word upper, the rest lower; any non-alphanumeric ends a word.

    Plain Latin and Cyrillic words between spaces, the usual case, need no splitting into words. ``apart``: no letter
    stands behind a digit.
    """

    def titled(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(_WORD_OR_GAP), F.lit(1))
        upper = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
        special = has_other(text) if apart else has_other(text) | text.rlike(_LETTER_AFTER_DIGIT)
        return F.when(special, F.array_join(upper, "")).otherwise(F.initcap(text))

    return bind(col, titled)


def clean_text_basic(col: Column) -> Column:
    return title_case(trim_text(squeeze_ws(col)))


def clean_text(col: Column, readings: Column | None = None) -> Column:
    """The full cleaning chain: transliterate, split camel case, pad numbers, strip specials, basic.

    Each step before the basic one only adds spaces or turns characters into spaces, and runs of
    spaces collapse at the end. So two passes do: one breaks words at capitals and at both ends of
    digit runs, one reduces every run of specials and white space to a single space.
    """
    if readings is not None:
        col = transliterate(col, readings)
    broken = F.regexp_replace(col, _BREAK, " $1")
    return title_case(trim_text(F.regexp_replace(broken, _GAP, " ")), apart=True)


def clean_text_steps(col: Column) -> Column:
    """The same chain one rule after the other, without transliteration; the definition of the result."""
    for step in (split_lower_camel, split_capitals, pad_numbers, strip_specials):
        col = step(col)
    return clean_text_basic(col)
