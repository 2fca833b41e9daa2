"""Term frequencies of texts, per unit and combined, and what a word cloud needs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubscope.functions.format import clean_word, font_size, palette_slot, rotation
from pubscope.session import cut, small

# Words common to every unit's description.
CUSTOM_STOPWORDS = (
    "project", "research", "study", "analysis", "data", "also", "within", "including", "would", "may", "one", "two",
    "focus", "aim", "seek", "explore", "examine", "investigate", "address", "consider", "provide", "use", "take",
    "make", "mean", "way", "part", "well", "new", "first", "three", "often", "different", "specific", "particular",
    "various", "thus", "therefore", "however", "order", "approach", "perspective", "question",
)

#: How a text is cut: at blanks with punctuation taken off both ends, or at everything that is no letter.
WORDS, LETTERS = "words", "letters"


# Spark's English stopwords.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def stopwords(language: str = "english", extra: tuple[str, ...] = CUSTOM_STOPWORDS) -> list[str]:
    """Spark's list of a language, and the corpus's. Languages other than English are read from Spark."""
    if language == "english":
        return sorted({*ENGLISH, *extra})
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords(language), *extra})


def tokens_of(text: Column, mode: str = WORDS) -> Column:
    """The lower-case tokens of a text in order.

    ``words``: a hyphenated compound is one token (which the letters-only test then drops), as a word tokenizer has it;
    ``letters``: every run of letters.
    """
    if mode == LETTERS:
        return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")
    clean = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.filter(F.transform(F.split(F.lower(text), r"(?U)\s+"), clean), lambda t: t != "")


def suffix_lemma(token: Column) -> Column:
    """A plain rule for plurals and verb forms, for use without a dictionary: first as a noun, then as a verb."""
    noun = (
        F.when(token.rlike("^.{2,}ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("^.{2,}(?:ss|sh|ch|x|z)es$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("^.{2,}[^sui]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )
    verb = F.when(token.rlike("^.{4,}[^e]ing$"), F.regexp_replace(token, "ing$", "")).when(token.rlike("^.{4,}[^e]ed$"), F.regexp_replace(token, "ed$", "")).otherwise(token)
    return F.when(noun != token, noun).otherwise(verb)


def _tokens(texts: DataFrame, unit: str, text: str, mode: str, position: list[str] | None) -> DataFrame:
    """unit, token, position of every token."""
    where = [F.col(p) for p in position or []]
    cut_up = texts.select(F.col(unit).alias("unit"), *[w.alias(f"p{i}") for i, w in enumerate(where)], F.posexplode(tokens_of(F.col(text), mode)).alias("at", "token"))
    place: Column = F.struct(*[F.col(f"p{i}") for i in range(len(where))], "at")
    if len(where) == 1 and isinstance(cut_up.schema["p0"].dataType, T.IntegralType):
        # one number orders the same, and its minimum is found by hashing, where a struct's would sort all tokens
        place = F.col("p0").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("at").cast("decimal(10,0)")
    return cut_up.select("unit", "token", place.alias("position"))


def _lemmatised(tokens: DataFrame, min_length: int, stop: list[str] | None, lemmas: DataFrame | None) -> DataFrame:
    """Rows with a token that counts, with its lemma as ``term``."""
    stop = stopwords() if stop is None else stop
    kept = tokens.where(F.col("token").rlike(r"^\p{L}+$") & (F.length("token") >= min_length) & ~F.col("token").isin(stop))
    if lemmas is None:
        lemma = suffix_lemma(F.col("token"))
    else:
        kept = kept.join(small(lemmas), "token", "left")
        lemma = F.when(F.col("noun") != F.col("token"), F.col("noun")).otherwise(F.coalesce("verb", "token"))
    return kept.withColumn("term", lemma).where(~F.col("term").isin(stop))


def terms(texts: DataFrame, unit: str, text: str, min_length: int = 2, stop: list[str] | None = None, lemmas: DataFrame | None = None, mode: str = WORDS, position: list[str] | None = None) -> DataFrame:
    """unit, term, position of every token that counts: letters only, long enough, no stopword before or after its lemma.

    ``lemmas``: token, noun, verb (either may be null), as a dictionary gives them; without it the suffix rule stands
    in. ``position`` columns order the texts of a unit, for ties by first use.
    """
    return _lemmatised(_tokens(texts, unit, text, mode, position), min_length, stop, lemmas).select("unit", "term", "position")


def term_counts(texts: DataFrame, unit: str, text: str, min_length: int = 2, stop: list[str] | None = None, lemmas: DataFrame | None = None, mode: str = WORDS, position: list[str] | None = None) -> DataFrame:
    """unit, term, n, first: the same tokens counted. They are counted as written first, so a token is judged and lemmatised once per unit."""
    written = _tokens(texts, unit, text, mode, position).groupBy("unit", "token").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return _lemmatised(written, min_length, stop, lemmas).groupBy("unit", "term").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def frequencies(found: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """unit, term, n, first: counts per unit, and combined under a null unit over the member units (all without ``members``).

    One aggregation per (unit, term), cut, feeds both; the combined one sums its results. ``found``: ``terms`` or
    ``term_counts``.
    """
    per_unit = found if "n" in found.columns else found.groupBy("unit", "term").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    per_unit = cut(per_unit, "terms")
    of = per_unit if members is None else per_unit.join(small(members.select("unit")), "unit", "left_semi")
    combined = of.groupBy("term").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select(F.lit(None).cast(per_unit.schema["unit"].dataType).alias("unit"), "term", "n", "first")
    return per_unit.unionByName(combined)


def most_common(freq: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` terms of each unit: unit, text, size, rank; ties by first use, then by term."""
    order = W.partitionBy("unit").orderBy(F.desc("n"), "first", "term")
    return freq.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_n).select("unit", F.col("term").alias("text"), F.col("n").alias("size"), "rank")


def token_totals(found: DataFrame) -> DataFrame:
    """unit, tokens: how many tokens count per unit, and under a null unit in all."""
    n = F.sum("n") if "n" in found.columns else F.count("*")
    return found.rollup("unit").agg(n.alias("tokens"), F.grouping_id().alias("level")).select("unit", "tokens", "level")


def merge_groups(words: DataFrame, order: Column) -> DataFrame:
    """text, size, units: the words of several units with sizes summed and the units in the order given."""
    grouped = words.groupBy("text").agg(F.sum("size").alias("size"), F.array_sort(F.collect_set(F.struct(order.alias("o"), "unit"))).alias("u"))
    return grouped.select("text", "size", F.array_distinct(F.transform("u", lambda x: x["unit"])).alias("units"))


def prepare(words: DataFrame, count: int, tie: str) -> DataFrame:
    """The ``count`` largest words, cleaned, with their rank: text, size, original_size, rank."""
    clean = words.withColumn("text", clean_word(F.col("text"))).where((F.length("text") > 0) & ~F.isnan(F.col("size").cast("double")) & (F.abs(F.col("size").cast("double")) < float("inf")))
    top = clean.orderBy(F.desc("size"), tie).limit(count)
    return top.withColumn("original_size", F.col("size")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), tie)).cast("bigint"))


def layout(prepared: DataFrame, area: float, slots: int = 6, least: float = 10.0, most: float | None = None) -> DataFrame:
    """Prepared words with share of the peak, font size (between ``least`` and ``most``), palette slot and rotation. The windows run over the shown words only."""
    everything = W.partitionBy()
    n, peak = F.count("*").over(everything), F.max("size").over(everything)
    font = font_size(F.col("size"), peak, n, area, least=least, most=most)
    return prepared.select("text", "size", "rank", (F.col("size") / peak * 100).alias("share"), font.alias("font"), palette_slot(F.col("rank"), n, slots).alias("slot"), rotation(F.col("text"), F.col("rank")).alias("rotation"))


def context_figures(words: DataFrame) -> DataFrame:
    """One row: occurrences and terms shown."""
    return words.agg(F.sum("size").alias("occurrences"), F.count("*").alias("terms"))
