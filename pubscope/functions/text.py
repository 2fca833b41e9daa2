"""Text folding and keying as column expressions.

Everything that Java regular expressions can say stays in the JVM. Unicode normal forms have no built-in; where they
matter, only the values that can change under normalisation are sent through an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside of a regex class: every Unicode blank (the separators, tab, line ends, no-break spaces).
BLANK = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Marks without width or meaning.
INVISIBLE = "​‌‍‎‏⁠﻿"


def strip_blank(c: Column) -> Column:
    """Without outer Unicode blanks; null stays null."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of Unicode blanks become one space, outer ones go."""
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def clean_text(c: Column) -> Column:
    """Drop invisible marks, turn no-break spaces into spaces, squeeze."""
    return squeeze(F.translate(c, INVISIBLE, ""))


def present(c: Column) -> Column:
    """Null for null, empty and blank strings, else the value."""
    return F.when(F.length(strip_blank(c)) > 0, c)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _fold_exact(s: pd.Series) -> pd.Series:
    return s.map(fold_py)


@F.pandas_udf(T.StringType())
def _fold_search_exact(s: pd.Series) -> pd.Series:
    return s.map(fold_search_py)


def nfc(c: Column) -> Column:
    """Composed form. Text below U+0300 is composed already, so only other values reach Python (as nulls otherwise)."""
    odd = c.rlike(r"[^\x{0}-\x{2ff}]")
    return F.when(odd, _nfc(F.when(odd, c))).otherwise(c)


def fold_py(v: str | None) -> str | None:
    """Lower case, compatibility-decomposed, without combining marks (the keying fold)."""
    if v is None:
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(ch))


def is_diacritic(ch: str) -> bool:
    """Approximation of the Unicode property Diacritic: combining marks, modifier symbols and letters that mark.

    The property itself is not in Python's unicodedata; general categories Mn, Sk and Lm below U+0370 cover the
    scripts of the register. Unicode version: that of the running Python.
    """
    cat = unicodedata.category(ch)
    return unicodedata.combining(ch) != 0 or cat == "Sk" or (cat == "Lm" and ch < "Ͱ") or ch == "·"


def fold_search_py(v: str | None) -> str | None:
    """Compatibility-decomposed, without diacritics, lower case (the search fold)."""
    if v is None:
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not is_diacritic(ch)).lower()


def _latin_pairs() -> tuple[str, str]:
    """One-to-one folds of lower-case Latin letters, generated from the Unicode data."""
    src, dst = [], []
    for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for cp in range(a, b):
            ch = chr(cp)
            out = fold_py(ch)
            if ch == ch.lower() and out is not None and len(out) == 1 and out != ch:
                src.append(ch)
                dst.append(out)
    return "".join(src), "".join(dst)


_SRC, _DST = _latin_pairs()
#: What a text that was folded natively may hold for the result to be exact: ASCII, letters that have no decomposition,
#: quotes and dashes that have none. Anything else in it (a combining mark, a ligature, another script) asks for the exact fold.
_EXACT = r"^[\x{0}-\x{7f}ßøæœđłıðþ«»\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2027}\x{2030}\x{2031}\x{2039}\x{203a}]*$"


def fold_rough(c: Column) -> Column:
    """Lower case without Latin accents, in the JVM alone; for keys that need no exact fold."""
    return F.translate(F.lower(c), _SRC, _DST)


def fold_key(c: Column) -> Column:
    """The keying fold: natively for Latin text, through an Arrow function for what the native path cannot fold exactly."""
    rough = fold_rough(c)
    native = rough.rlike(_EXACT)
    return F.when(native, rough).otherwise(_fold_exact(F.when(~native, c)))


def fold_search(c: Column) -> Column:
    """The search fold; as fold_key, but spacing diacritics go as well."""
    rough = fold_rough(c)
    native = rough.rlike(_EXACT) & ~c.rlike(r"[\^`]")
    return F.when(native, rough).otherwise(_fold_search_exact(F.when(~native, c)))


#: Articles that do not count at the start of a key.
ARTICLES = ("the", "le", "la", "les", "der", "die", "das", "el", "al")


def key_of_folded(folded: Column) -> Column:
    """The merge key of an already folded string: letters and digits only, one space between words, no leading article.

    A string without letters or digits keeps its folded form, so that it never shares a key with another one.
    """
    words = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(words, f"^({'|'.join(ARTICLES)}) +", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.trim(folded))


def merge_key(c: Column) -> Column:
    """The key that two spellings of one entity share: case, accents, punctuation, spacing and a leading article do not count."""
    return key_of_folded(fold_key(c))


def slug_key(c: Column) -> Column:
    """The plain slug that a reference names, however it is written.

    Takes links, paths, query and fragment, percent escapes, letter case, outer slashes and blanks. Null stays null; a
    value that names nothing (such as a bare fragment) becomes the empty string.
    """
    s = strip_blank(c)
    s = F.regexp_replace(s, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    s = F.regexp_replace(s, r"(?s)[?#].*$", "")
    s = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    s = F.regexp_replace(s, f"^[/{BLANK}]+|[/{BLANK}]+$", "")
    return F.lower(F.substring_index(s, "/", -1))


def fingerprint(*cols: Column) -> Column:
    """Listing fields joined by " | ", missing ones as empty strings."""
    return F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cols])
