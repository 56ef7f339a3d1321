"""Column helpers for text. All of them stay inside the JVM except ``nfkc``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.functions import fixed_values as fv

# Whitespace and word characters, spelled out so that every engine agrees on them.
BLANKS = " \t\n\r\x0b\f"
WORD = r"\p{L}\p{N}_"
NOT_BEFORE = rf"(?<![{WORD}])"
NOT_AFTER = rf"(?![{WORD}])"


def first_of(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all of them without ``n``."""
    return items if n is None else F.slice(items, 1, n)


def start_of(text: Column, n: int | None) -> Column:
    """The first ``n`` characters of a text; the whole text without ``n``."""
    return text if n is None else F.substring(text, 1, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda body that mentions an expression re-evaluates it for every element; binding it
    to a lambda variable keeps array work linear.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    """Whitespace-separated words; no element for empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def word_array(words: Iterable[str]) -> Column:
    """A constant array of strings as one literal; Catalyst folds the split."""
    return F.split(F.lit("\u0001".join(words)), "\u0001")


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """Whether one of a fixed list of needles occurs in the text."""
    return c.rlike("|".join(re.escape(n) for n in needles))


def count_contained(c: Column, needles: Iterable[str]) -> Column:
    """How many of a fixed list of needles occur in the text."""
    return let(c, lambda t: F.size(F.filter(word_array(needles), lambda n: F.contains(t, n))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs of an array of words."""
    pairs = let(
        tokens,
        lambda t: F.when(
            F.size(t) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(t) - 1),
                lambda i: F.concat_ws("\u0001", F.element_at(t, i), F.element_at(t, i + 1)),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(pairs)


def first_per_key(items: Column, key: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Drop repeated items of one array, keeping the first of each key and the order.

    ``keep(item)`` true keeps an item whatever its key. Sorting makes it n log n inside the
    row: no shuffle and no quadratic scan.
    """
    tagged = F.transform(
        items,
        lambda x, i: F.struct(F.when(keep(x), F.lit(None)).otherwise(key(x)).alias("k"), i.alias("i"), x.alias("x")),
    )
    firsts = let(
        F.sort_array(tagged),
        lambda s: F.filter(
            s,
            lambda e, p: e["k"].isNull()
            | (p == 0)
            | ~e["k"].eqNullSafe(F.get(s, p - 1)["k"]),
        ),
    )
    back = F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"])


# Characters below U+0180 that compatibility composition changes; text made only of the others
# is already normal and never leaves the JVM.
_UNSTABLE = "".join(chr(c) for c in range(0x180) if unicodedata.normalize("NFKC", chr(c)) != chr(c))
_NEEDS_NFKC = f"[^\\u0000-\\u017F]|[{_UNSTABLE}]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode NFKC; only rows that can change are sent to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(_NEEDS_NFKC), c)), c)


def tokens_of(c: Column) -> Column:
    """Lower-case tokens longer than one character."""
    return F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({fv.TOKEN})"), F.lit(1)), lambda t: F.length(t) > 1
    )
