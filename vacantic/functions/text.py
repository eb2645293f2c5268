"""Text cleaning.

Most text is plain ASCII without entities and never leaves the JVM: the
regular-expression part below is pure SQL.  Only rows that need Unicode
compatibility folding, case folding or entity decoding, for which Spark has no
built-in, are sent through one Arrow pass (`_markup_udf`); all other rows pass
null to it.  `tests/test_text.py` checks that both ways agree.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantic.functions.let import let
from vacantic.rules import SUMMARY_MAX_CHARS

# fixed patterns: what counts as a block end, a tag, a control character
BLOCK_END = r"(?is)<(?:/(?:p|div|li|h[1-6]|tr|section|article|br)|br\s*/?>)"
TAG = r"<[^>]+>"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
QUOTES_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0"
QUOTES_TO = "''\"\"-- "

_BLOCK, _TAG, _CTRL = re.compile(BLOCK_END), re.compile(TAG), re.compile(CONTROL)


# --- rows that need Unicode or entity work: one Arrow pass ---------------------------------
BATCH_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
# fixed value: HotSpot never compiles a method of more bytes
METHOD_BYTES = 8000
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def _unless_set(key: str, value: int) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and key not in spark.conf.getAll:
        spark.conf.set(key, str(value))


def small_batches() -> None:
    """Bound an Arrow batch of texts by bytes, not only by 10,000 rows, unless the session sets a bound of its own.

    A worker holds some ten copies of a batch (Arrow, strings in and out, in several columns).
    """
    _unless_set(_LIMIT, BATCH_BYTES)


def small_methods() -> None:
    """Have operators with long expressions run one by one, unless the session sets a bound of its own.

    Joined into one generated method they pass the size the JVM compiles, and every row is interpreted.
    """
    _unless_set(_METHOD, METHOD_BYTES)


def _decode(value: str) -> str:
    for _ in range(4):
        if "&" not in value:
            return value
        once = html.unescape(value)
        if once == value:
            return value
        value = once
    return value


def _tidy(value: str) -> str:
    if value.isascii():
        return _CTRL.sub("", value)
    if not unicodedata.is_normalized("NFKC", value):
        value = unicodedata.normalize("NFKC", value)
    for old, new in zip(QUOTES_FROM, QUOTES_TO):
        value = value.replace(old, new)
    return _CTRL.sub("", value)


def _one_line(value: str) -> str:
    return " ".join(_tidy(value).split())


def _plain(value: str) -> str:
    for _ in range(2):
        value = _decode(value)
        if "<" not in value:
            break
        value = _TAG.sub(" ", _BLOCK.sub("\n", value))
        if ">" not in value:
            break
    rows = (" ".join(row.split()) for row in _tidy(value).split("\n"))
    return "\n".join(row for row in rows if row)


@F.pandas_udf(T.StringType())
def _one_line_udf(values: pd.Series) -> pd.Series:
    return values.map(_one_line, na_action="ignore")


# lists come as JSON texts: a column of lists is dear to write row by row, though most of its rows are null
@F.pandas_udf(T.ArrayType(T.StringType()))
def _one_line_list_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda row: [_one_line(v) for v in json.loads(row)], na_action="ignore")


@F.pandas_udf(T.StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    return values.map(_plain, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain_list_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda row: [_plain(v) for v in json.loads(row)], na_action="ignore")


@F.pandas_udf(T.StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _one_line(_plain(v).casefold()), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _canonical_list_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda row: [_one_line(_plain(v).casefold()) for v in json.loads(row)], na_action="ignore")


# --- rows that stay in the JVM ----------------------------------------------------------------
# simple text: printable ASCII, tab and line ends; anything else (control characters included) goes to Python
_NOT_SIMPLE = r"[^\t\n\r\x20-\x7e]"


def _ascii(text: Column) -> Column:
    return ~text.rlike(_NOT_SIMPLE)


def _ascii_without_entities(text: Column) -> Column:
    return ~text.rlike(_NOT_SIMPLE + "|&")


# Java's engine tries a pattern at every character: these two fail at a letter after one test, and match only what is
# not a single blank already
_SPACES = r"\s(?:(?<=[^ ])\s*|\s+)"
_SPACES_OF_ROW = r"[^\S\n](?:(?<=[^ ])[^\S\n]*|[^\S\n]+)"


def _jvm_one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def _jvm_strip(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(F.regexp_replace(text, BLOCK_END, "\n"), TAG, " ")).otherwise(text)


def _jvm_strip_twice(text: Column) -> Column:
    return let(_jvm_strip(text), lambda t: F.when(t.contains(">"), _jvm_strip(t)).otherwise(t))


def _jvm_plain(text: Column) -> Column:
    flat = F.regexp_replace(_jvm_strip_twice(text), _SPACES_OF_ROW, " ")
    return let(flat, lambda t: F.btrim(F.when(t.contains("\n"), F.regexp_replace(t, r" *\n[ \n]*", "\n")).otherwise(t), F.lit(" \n")))


def _jvm_canonical(text: Column) -> Column:
    return F.lower(_jvm_one_line(_jvm_strip_twice(text)))


def _either(text: Column, simple: Callable[[Column], Column], jvm: Callable[[Column], Column],
            udf: Callable[[Column], Column]) -> Column:
    """JVM way for simple rows; all others, and only they, go to Python, which has a text for each of them."""
    small_batches()
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(udf(let(text, lambda t: F.when(~simple(t), t))), let(text, jvm))


def normalize_ws(text: Column) -> Column:
    """Compatibility folding, plain quotes, no control characters, single spaces."""
    return _either(text, _ascii, _jvm_one_line, _one_line_udf)


def html_to_text(text: Column) -> Column:
    """Markup to text; block ends become line breaks, empty lines go."""
    return _either(text, _ascii_without_entities, _jvm_plain, _plain_udf)


def canonical_text(text: Column) -> Column:
    """One-line, case-folded form for matching and hashing."""
    return _either(text, _ascii_without_entities, _jvm_canonical, _canonical_udf)


def normalize_ws_list(texts: Column) -> Column:
    """C1 for an array of short strings."""
    small_batches()
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    simple = F.forall(texts, _ascii)
    return F.coalesce(_one_line_list_udf(F.when(~simple, F.to_json(texts))), F.transform(texts, _jvm_one_line))


def html_list_to_text(texts: Column) -> Column:
    """C2 for an array of fragments, element by element."""
    small_batches()
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    simple = F.forall(texts, _ascii_without_entities)
    return F.coalesce(_plain_list_udf(F.when(~simple, F.to_json(texts))), F.transform(texts, _jvm_plain))


def canonical_text_list(texts: Column) -> Column:
    """C3 for an array of short strings."""
    small_batches()
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    simple = F.forall(texts, _ascii_without_entities)
    return F.coalesce(_canonical_list_udf(F.when(~simple, F.to_json(texts))), F.transform(texts, _jvm_canonical))


def truncate_summary(text: Column, limit: int = SUMMARY_MAX_CHARS) -> Column:
    """C4: at most `limit` characters, cut at the last space, with an ellipsis."""
    def no_blanks_after(t: Column) -> Column:
        # a look at the last character first: the pattern is tried at every blank
        return F.when(F.substring(t, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)\s+$", "")).otherwise(t)

    def no_blanks_before(t: Column) -> Column:
        return F.when(F.substring(t, 1, 1).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+", "")).otherwise(t)

    def without_last_word(t: Column) -> Column:
        rest = F.length(t) - F.length(F.substring_index(t, " ", -1)) - 1
        return F.when(t.contains(" "), t.substr(F.lit(1), rest)).otherwise(t)

    def shorten(t: Column) -> Column:
        cut = let(let(F.substring(t, 1, limit - 1), no_blanks_after), without_last_word)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))

    return let(text, lambda x: F.when(x != "", let(let(let(x, no_blanks_before), no_blanks_after), shorten)))


def richest_text(description: Column, summary: Column) -> Column:
    """The longer of the two cleaned texts, the description on a tie."""
    d, s = F.coalesce(description, F.lit("")), F.coalesce(summary, F.lit(""))
    return F.when(F.length(d) >= F.length(s), d).otherwise(s)


def _named_entities(text: Column) -> Column:
    # fixed values: the entities a page without a browser decodes, in this order
    for pattern, value in [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
                           ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&#x27;", "'")]:
        text = F.regexp_replace(text, pattern, value)
    return text


def clean_summary(text: Column) -> Column:
    """C17: display form of a summary; empty when more than 8 % of it is markup."""
    block = r"(?i)</(?:p|div|li|h[1-6]|tr|section|article)|<br\s*/?>"

    def strip(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, block, "\n"), TAG, " ")

    def drop_soup(flat: Column) -> Column:
        share = F.regexp_count(flat, F.lit("[<>&]")) / F.greatest(F.length(flat), F.lit(1))
        return F.when(share > 0.08, F.lit("")).otherwise(flat)

    once = strip(_named_entities(F.coalesce(text, F.lit(""))))
    again = let(once, lambda t: F.when(t.contains("<") & t.contains(">"), strip(_named_entities(t))).otherwise(t))
    flat = F.regexp_replace(again, r"(?U)[^\S\n]+", " ")
    return let(F.btrim(F.regexp_replace(flat, r" *\n[ \n]*", "\n"), F.lit(" \n")), drop_soup)


WORD_MARK = "\x01"


def mark_words(text: Column, extra: str = "") -> Column:
    """Put a mark before and after every word, so that a whole-phrase match becomes a plain substring test.

    `extra` names characters that count as parts of words (for example `+#` for `c++`).
    """
    return F.regexp_replace(text, r"([\p{L}\p{N}_" + extra + "]++)", WORD_MARK + "$1" + WORD_MARK)


def marked_phrase(phrase: str, extra: str = "") -> str:
    """The phrase with the same marks, made once on the driver from a rule row."""
    return re.sub(r"([\w" + extra + "]+)", WORD_MARK + r"\1" + WORD_MARK, phrase)


def is_readable_summary(text: Column) -> Column:
    return F.length(clean_summary(text)) >= 40
