"""Consolidation of the spellings of people and venues by key, by curated alias, and by fuller name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubscope.functions.names import canonical_name, display_name, extends, name_key
from pubscope.functions.text import merge_key
from pubscope.session import cut, small


def alias_table(df: DataFrame, section: str) -> DataFrame:
    """variant_key, target of one section of the curated aliases (section, variant, target)."""
    rows = df.where((F.col("section") == section) & ~F.col("variant").startswith("_"))
    return rows.select(merge_key(F.col("variant")).alias("variant_key"), "target").groupBy("variant_key").agg(F.max("target").alias("target"))


def read_names(names: DataFrame, raw: str = "name", aliases: DataFrame | None = None) -> DataFrame:
    """The occurrences with surname, given, display and key; those that are no names go.

    A curated alias replaces the name before anything is counted; ``applied`` then holds its target.
    """
    read = names.withColumn("n", canonical_name(F.col(raw))).where("n is not null").select(*names.columns, "n.surname", "n.given")
    shown = read.withColumn("display", display_name(F.col("surname"), F.col("given")))
    if aliases is None:
        shown = shown.withColumn("applied", F.lit(None).cast("string"))
    else:
        target = canonical_name(F.col("target"))
        joined = shown.withColumn("variant_key", merge_key(F.col("display"))).join(small(aliases), "variant_key", "left").withColumn("t", target)
        use = F.col("t").isNotNull()
        surname, given = F.when(use, F.col("t.surname")).otherwise(F.col("surname")), F.when(use, F.col("t.given")).otherwise(F.col("given"))
        shown = joined.select(*names.columns, surname.alias("surname"), given.alias("given"), F.when(use, F.col("target")).alias("applied")).withColumn("display", display_name(F.col("surname"), F.col("given")))
    return shown.withColumn("key", name_key(F.col("surname"), F.col("given")))


def name_keys(read: DataFrame, order: list[str]) -> DataFrame:
    """key, count, surface: how often each person's key occurs, and its longest display (the first by ``order`` on ties)."""
    first = F.min(F.struct(-F.length("display"), *order, "display"))
    return read.groupBy("key").agg(F.count("*").alias("count"), first.alias("f")).select("key", "count", F.col("f.display").alias("surface"))


#: Keys of more given names than this don't list their shortened forms, whose number doubles with each.
FORMS_OF = 6


def shortened(tokens: Column, equal_length: bool = False) -> Column:
    """All given names that extend to these: the first ones, at least one fewer, each as it is or as its initial."""
    first = tokens if equal_length else F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    begin = F.struct(F.array(F.lit("")).alias("last"), F.array().cast("array<string>").alias("all"))

    def longer(acc: Column, t: Column) -> Column:
        last = F.flatten(F.transform(acc["last"], lambda p: F.array(F.ltrim(F.concat(p, F.lit(" "), t)), F.ltrim(F.concat(p, F.lit(" "), F.left(t, F.lit(1)))))))
        return F.struct(last.alias("last"), F.concat(acc["all"], last).alias("all"))

    return F.array_distinct(F.aggregate(first, begin, longer, lambda acc: acc["all"]))


def fuller_names(keys: DataFrame, fold_equal_length: bool = False) -> DataFrame:
    """alias, target: each key of a shortened given name with the only fuller key that it can belong to.

    Each key lists the shortened forms that extend to it, and these are joined by equality, so namesakes are never
    compared pair by pair. Only keys of more than FORMS_OF given names are compared with the keys of their surname and
    first letter. A key with two candidates stays, and so does one whose candidate is itself shortened.
    """
    split = keys.select("key", F.split_part("key", F.lit("|"), F.lit(1)).alias("s"), F.split_part("key", F.lit("|"), F.lit(2)).alias("g")).where("g <> ''")
    split = split.withColumn("t", F.filter(F.split("g", " "), lambda x: x != ""))
    few, many = split.where(F.size("t") <= FORMS_OF), split.where(F.size("t") > FORMS_OF)
    forms = few.select("s", F.col("key").alias("target"), F.explode(shortened(F.col("t"), fold_equal_length)).alias("g"))
    fits = split.join(forms, ["s", "g"]).where("key <> target").select("key", "target")
    long = many.select("s", F.left("g", F.lit(1)).alias("c"), F.col("g").alias("long"), F.col("key").alias("target"))
    rest = split.withColumn("c", F.left("g", F.lit(1))).join(long, ["s", "c"]).where((F.col("key") != F.col("target")) & extends(F.col("g"), F.col("long"), fold_equal_length))
    found = fits.unionByName(rest.select("key", "target"))
    only = found.groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").select(F.col("key").alias("alias"), "target")
    return only.join(only.select(F.col("alias").alias("target")), "target", "left_anti").select("alias", "target")


def resolve_names(names: DataFrame, order: list[str], raw: str = "name", aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences with ``author``, the name under which the person appears; merges: variant, target)."""
    read = cut(read_names(names, raw, aliases), "names")
    keys = cut(name_keys(read, order), "keys")
    links = fuller_names(keys)
    shown = keys.join(links, F.col("key") == F.col("alias"), "left").select("key", "surface", F.coalesce("target", "key").alias("root"))
    roots = shown.join(keys.select(F.col("key").alias("root"), F.col("surface").alias("author")), "root")
    out = read.join(roots.select("key", "author"), "key").select(*names.columns, "author")
    merges = roots.where(F.col("key") != F.col("root")).select(F.col("surface").alias("variant"), F.col("author").alias("target"))
    if aliases is not None:
        curated = read_applied(names, raw, aliases)
        merges = merges.unionByName(curated)
    return out, merges


def read_applied(names: DataFrame, raw: str, aliases: DataFrame) -> DataFrame:
    """variant, target of the curated aliases that were used, by the display they replaced."""
    n = names.select(canonical_name(F.col(raw)).alias("n")).where("n is not null")
    shown = n.select(display_name(F.col("n.surname"), F.col("n.given")).alias("variant")).distinct()
    return shown.withColumn("variant_key", merge_key(F.col("variant"))).join(small(aliases), "variant_key").select("variant", "target")


def resolve_venues(values: DataFrame, value: str = "value", aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, canonical, n; merges: canonical, variants) of one venue field's occurrences.

    The form kept is the one used most, on ties the longer, then the alphabetically first. Distinct forms are keyed,
    not occurrences, so the fold runs once per spelling.
    """
    forms = values.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("form")).agg(F.count("*").alias("n"))
    keyed = forms.withColumn("own_key", merge_key(F.col("form")))
    if aliases is not None:
        keyed = keyed.join(small(aliases), F.col("own_key") == F.col("variant_key"), "left").withColumn("used", F.coalesce("target", "form"))
        keyed = keyed.withColumn("key", F.when(F.col("target").isNotNull(), merge_key(F.col("target"))).otherwise(F.col("own_key")))
    else:
        keyed = keyed.withColumn("used", F.col("form")).withColumn("key", F.col("own_key"))
    used = keyed.groupBy("key", "used").agg(F.sum("n").alias("n"), F.collect_set("form").alias("forms"))
    best = F.min(F.struct(-F.col("n"), -F.length("used"), "used"))
    by_key = used.groupBy("key").agg(best.alias("b"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("forms"))
    venues = by_key.select("key", F.col("b.used").alias("canonical"), "n", "forms")
    merges = venues.select("canonical", F.filter("forms", lambda f: f != F.col("canonical")).alias("variants")).where("size(variants) > 0")
    return venues.select("key", "canonical", "n"), merges
