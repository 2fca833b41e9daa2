"""Reading personal names as the register writes them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubscope.functions.text import BLANK, fold_rough, merge_key, strip_blank

# Trailing noise of a name, words that are no name, and particles that open a surname.
NOISE_TAIL = r"(?iU)\s*(\(.*?\)|\[.*?\]|,?\s*et\.?\s?al\.?|,?\s*u\.\s?a\.|,?\s*{guard}eds?\.?\)?)\s*$"
NO_NAMES = ("et al.", "et al", "u.a.", "and others")
PARTICLES = (
    "af", "al", "av", "ben", "bin", "bint", "da", "das", "de", "del", "della", "der", "di", "do", "dos", "du", "el",
    "ibn", "la", "le", "ten", "ter", "van", "von", "zu",
)


def split_authors(cell: Column) -> Column:
    """The names of a cell: separated by semicolons, or an even number of at least four comma pieces as pairs."""

    def read(part: Column) -> Column:
        pieces = F.filter(F.transform(F.split(part, ","), strip_blank), lambda p: p != "")
        pairs = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(2)), lambda i: F.concat(F.element_at(pieces, i), F.lit(", "), F.element_at(pieces, i + 1)))
        whole = F.filter(F.array(strip_blank(part)), lambda p: p != "")
        return F.when((F.size(pieces) >= 4) & (F.size(pieces) % 2 == 0), pairs).otherwise(whole)

    return F.flatten(F.transform(F.split(cell, ";"), read))


def split_names(cell: Column) -> Column:
    """The names of a cell that has semicolons only."""
    return F.filter(F.transform(F.split(cell, ";"), strip_blank), lambda p: p != "")


def strip_noise(name: Column, whole_words: bool = False) -> Column:
    """Without trailing notes of editorship and "et al.", however many are stacked.

    As the register's own tools read it, a name that ends in "ed" loses these letters; ``whole_words`` asks for a word
    boundary before the marker.
    """
    tail = NOISE_TAIL.replace("{guard}", r"(?<![\p{L}])" if whole_words else "")
    trim = lambda c: F.btrim(strip_blank(c), F.lit(",;"))
    # a note takes at least one of these along, so there are no more notes than of them
    most = F.greatest(F.coalesce(F.regexp_count(name, F.lit(r"(?i)[)\]]|al|u\.|ed")), F.lit(1)), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), most), trim(name), lambda x, _: trim(F.regexp_replace(x, tail, "")))


def canonical_name(raw: Column, whole_words: bool = False) -> Column:
    """struct(surname, given), or null if the text is no name. "Given Surname" is turned around, particles with the surname."""
    name = strip_noise(raw, whole_words)
    tokens = F.filter(F.split(name, f"[{BLANK}]+"), lambda t: t != "")
    folded = F.transform(tokens, lambda t: F.btrim(fold_rough(t), F.lit(".")))
    known = F.array(*[F.lit(p) for p in PARTICLES])
    opening = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.array_contains(known, F.get(folded, i)))
    at = F.coalesce(F.get(opening, F.lit(0)), F.size(tokens) - 1)
    turned = F.when(
        F.size(tokens) == 1, F.struct(F.get(tokens, F.lit(0)).alias("surname"), F.lit("").alias("given"))
    ).otherwise(F.struct(F.array_join(F.slice(tokens, at + 1, F.size(tokens)), " ").alias("surname"), F.array_join(F.slice(tokens, F.lit(1), at), " ").alias("given")))
    comma = F.struct(strip_blank(F.substring_index(name, ",", 1)).alias("surname"), strip_blank(F.substr(name, F.instr(name, ",") + 1)).alias("given"))
    is_name = (F.length(name) > 0) & ~fold_rough(name).isin(*NO_NAMES)
    return F.when(is_name, F.when(F.contains(name, F.lit(",")), comma).otherwise(turned))


def display_name(surname: Column, given: Column) -> Column:
    """ "Surname, Given", without a comma if there is no given name."""
    return F.btrim(strip_blank(F.concat(surname, F.lit(", "), given)), F.lit(","))


def name_key(surname: Column, given: Column) -> Column:
    """The key that two spellings of one person share."""
    return F.concat(F.coalesce(merge_key(surname), F.lit("")), F.lit("|"), F.coalesce(merge_key(given), F.lit("")))


def extends(shorter: Column, longer: Column, fold_equal_length: bool = False) -> Column:
    """Is ``longer`` the key of a given name with more detail: token by token equal, or the shorter one its initial?

    A key with as many tokens doesn't extend another, unless ``fold_equal_length`` is set (then "s" extends to
    "samuli"); equal keys never do.
    """
    s = F.filter(F.split(shorter, " "), lambda t: t != "")
    t = F.filter(F.split(longer, " "), lambda t: t != "")
    fits = F.zip_with(s, F.slice(t, F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda a, b: (a == b) | ((F.length(a) == 1) & b.startswith(a)))
    room = (F.size(s) <= F.size(t)) & (shorter != longer) if fold_equal_length else F.size(s) < F.size(t)
    return (F.size(s) > 0) & room & F.forall(fits, lambda x: F.coalesce(x, F.lit(False)))


def short_name(name: Column) -> Column:
    """ "Surname, Given Name" as "G. N. Surname"; a name without given name stays."""
    parts = F.split(name, ",")
    surname = F.trim(F.get(parts, F.lit(0)))
    given = F.filter(F.split(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), f"[{BLANK}]+"), lambda t: t != "")
    initials = F.array_join(F.transform(given, lambda t: F.concat(F.left(t, F.lit(1)), F.lit("."))), " ")
    return F.when(initials != "", F.concat(initials, F.lit(" "), surname)).otherwise(surname)
