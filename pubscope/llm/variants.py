"""Variant spellings of names typed by people: noisy-channel attribution to canonical forms.

A form is read into a *stem*: surname and first given name of a person, the folded words of a venue. Titles, notes,
order, case, accents and legal forms are undone by the reading. What remains is the noise: slips of typing, initials,
dropped middle names, short names, abbreviated words, subtitles. Stems are ranked by how often their forms occur in the
register; frequent ones are the candidate canonical forms, and each variant is attached to the candidate with the
highest posterior: prior (what it would explain) times likelihood of the noise. A slip's likelihood depends on its kind
and on the length of the name, since short names have real neighbours. Two stems whose differing words both stand in
other stems too are two entities.

Which short name stands for which name, and which abbreviation for which word, is learned from the register: names that
share a beginning or an end and stand under the same surnames far more often than chance; a dotted word that begins
another one (with or without its vowels) between the same other words. Short lists of irregular ones are the prior.

All of this is done by equi-joins on keys (deletion signatures for slips, surname and initial for initials), so no
group of namesakes is ever compared pair by pair. Tables that grow with the register are joined by shuffle whatever the
planner takes their size for, so the driver holds only the word lists and a bounded table of short names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pubscope.functions.names import PARTICLES
from pubscope.functions.text import fold_py
from pubscope.session import cut_large, small

# Short forms of given names in general use (English, German, Spanish, Italian, French, Slavic, Turkish)
# that don't follow from their beginning or end alone.
SHORT_NAMES = """
alexander: sascha sasha xander sandy alex
alexandra: sascha sasha sandra sandy alex
alfred: fred freddy
andrew: drew andy
ann: nan nancy
anthony: tony
antonia: toni
antonio: toni tonio
benjamin: ben benny
catherine: kate kitty
charles: charlie chuck
christopher: kit chris
christina: tina chris
daniel: dan danny
david: dave
deborah: debbie
dorothea: thea dora dorle
edward: ed eddie ned ted
elisabeth: lisa liesl betty
elizabeth: liz lizzie beth betty bess eliza lisa
frances: fanny
francesca: franca cesca
francis: frank
francisco: paco pancho
frederick: fred
friedrich: fritz fred
gerald: jerry
giovanni: gianni
giuseppe: beppe
guillermo: memo
gunther: gunni
harold: harry hal
heinrich: heinz heiner
helena: lena leni
henry: hank hal
ibrahim: ibo
ignacio: nacho
ivan: vanya
jacob: jake
james: jim jimmy jamie
johann: hans hannes
johanna: hanna hanni
johannes: hans hannes jan jo
john: jack johnny jon
jose: pepe
josef: sepp jupp
joseph: joe joey
josephine: josie jo
jurgen: jogi
karl: kalle
katharina: kathi kati katja kat
katherine: kate kathy kitty kay
lawrence: larry
leonard: len lenny leo
ludwig: lutz
magdalena: lena leni
margaret: maggie meg peggy marge greta
margarethe: grete greta
maria: mia
mary: molly polly
mehmet: memo
michael: mike mick misha
mikhail: misha
mohammed: mo
natalia: natasha
nicholas: nick
nikolaus: klaus klaas nico niko
patricia: patty trish
patrick: paddy
penelope: penny
rebecca: becky
richard: dick rick ricky
robert: bob bobby rob robbie
rudolf: rolf rudi
samuel: sam sammy
sarah: sally sadie
stephen: steve
susan: sue susie
susanna: sanna susi sue
theodor: ted
theodore: ted teddy
theresa: tess
thomas: tom tommy
tomasz: tomek
ulrich: uli ulli
ulrike: uli ulli rike
victoria: vicky tori
viktoria: vicky tori
vladimir: volodya
wilhelm: willi willy
wilhelmina: mina minna
william: bill billy will willy liam
zacharias: zach
"""
# Usual abbreviations of title words that are no beginning of the word.
SHORT_WORDS = """
abteilung: abt
associates: assocs
bulletin: bltn
department: dept
editions: eds edns
government: govt
international: intl
jahrbuch: jb jahrb
journal: jnl jrnl
limited: ltd
monatsschrift: mschr
monthly: mthly
national: natl
newsletter: nwsl
proceedings: procs
publications: pubs publs
publishers: pubs publs
quarterly: qtly qrtly
university: univ uni
verlag: vlg
weekly: wkly
zeitschrift: zs ztschr zschr
zeitung: ztg
"""
TITLES = frozenset("dr prof pd dipl ing mag phd hc habil sir dame med phil".split())
_LEGAL = re.compile(r"[\s,]*\b(?:gmbh\s*&\s*co\.?\s*kg|gmbh|ltd|inc|s\.\s?a\.|llc|plc|ag|kg)(?![\w])\.?", re.I)
_NOTE = re.compile(r"\s*[(\[][^)\]]*[)\]]|[\s,]*\b(?:et\.?\s?al\b\.?|u\.\s?a\.|and others\b)", re.I)
_INVERTED = re.compile(r"^(.+),\s+(.+\s(?:of|of the|des|de|für|in|for))\s*[.,:]?$", re.I)
_SUBTITLE = re.compile(r"\s*:.*$")
_BREAK = re.compile(r"(?<=\w\w)\.\s+(?=[A-ZÀ-Þ])")


def _pairs_of(text: str) -> list[tuple[str, str]]:
    return [(short, full) for line in text.split("\n") if line for full, _, rest in [line.partition(":")] for short in rest.split()]


#: Likelihoods of slips, as shares of the likeliest: neighbours exchanged, a letter doubled, one too many or missing, another one.
EXCHANGED, DOUBLED, EXTRA, OTHER = 1.0, 1.0, 0.7, 0.5
#: A slip is likelier than another name if its likelihood times the letters of the name reaches this.
SLIP_ODDS = 3.0
#: How much likelier the best candidate must be than one of another entity.
ODDS = 3
#: A word is one of its own and no slip of a neighbour if so many stems have it, and more than this share of those that have the neighbour.
OWN_STEMS, SLIP_SHARE = 3, 0.2
#: A short name is learned if it stands with the full one under so many surnames, so many times as often as chance, and
#: under this share of its own.
SHORT_SURNAMES, SHORT_LIFT, SHORT_SHARE = 3, 5.0, 0.3
#: Most short names, and most bytes of them, that are broadcast: few names are borne by very many.
SHORT_ROWS, SHORT_BYTES = 100_000, 8 << 20

_READ = "name_id long, field string, n long, kind string, stem string, words array<string>, heads array<int>, s string, i string, g string, mid string"


def spelled(text: str) -> str:
    """A folded word with umlauts written out (ue, oe, ae) spelled like those with points."""
    return re.sub(r"([aou])e", r"\1", text)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:-[^\W_]+)*\.?", text)


def initials(token: str) -> bool:
    """Up to three capitals without points."""
    return bool(re.fullmatch(r"[^\W\d_]{1,3}", token)) and token.isupper()


def read_person(form: str) -> tuple[str, str | None, str, str, str] | None:
    """(kind, stem, surname, given name or its initial, middle initial) of a person's name; kind 'full', 'init' or 'bare'."""
    text = re.sub(r"[\s ]+", " ", _NOTE.sub("", form)).strip(" ,;")
    surname, comma, given = text.partition(",")
    if comma and initials(given.strip()):
        given = " ".join(given.strip())
    if not comma:
        words = text.split()
        tokens = [t for k, t in enumerate(words) if fold_py(t).strip(".") not in TITLES or (k and k == len(words) - 1 and initials(t))]
        if not tokens:
            return None
        if len(tokens) > 1 and initials(tokens[-1]) and not tokens[0].endswith("."):
            surname, given = " ".join(tokens[:-1]), " ".join(tokens[-1])
        else:
            at = next((k for k in range(1, len(tokens)) if fold_py(tokens[k]) in PARTICLES), len(tokens) - 1)
            surname, given = " ".join(tokens[at:]), " ".join(tokens[:at])
    s = spelled("".join(re.findall(r"[^\W_]+", fold_py(surname))))
    g = [t for t in (fold_py(w).strip(".") for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*\.?", given.replace(".", ". "))) if t and t not in TITLES]
    g = [t for k, t in enumerate(g) if not k or t not in PARTICLES]
    if not s:
        return None
    if not g:
        return "bare", s, s, "", ""
    mid = g[1][0] if len(g) > 1 else ""
    if len(g[0]) == 1:
        return "init", None, s, g[0], mid
    first = spelled(g[0].replace("-", ""))
    return "full", f"{s}|{first}", s, first, mid


def read_venue(form: str) -> tuple[list[str], list[int]] | None:
    """The folded words of a journal or publisher, dotted ones with their point, and after how many words a subtitle may begin."""
    text = re.sub(r"[\s ]+", " ", form).strip()
    text = re.sub(r"\s*\((?:online|print)\)", "", text, flags=re.I)
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", _LEGAL.sub(" ", text)).strip()
    text = _SUBTITLE.sub("", text) if _SUBTITLE.sub("", text).strip(" ,.:;") else text
    half = text.split(", ")
    if len(half) > 1 and len(half) % 2 == 0:
        a, b = ", ".join(half[: len(half) // 2]), ", ".join(half[len(half) // 2 :])
        if fold_py(a).strip(".") == fold_py(b).strip("."):
            text = a
    if m := _INVERTED.match(text.strip(" ,:;")):
        text = f"{m.group(2)} {m.group(1)}"
    text = re.sub(r"\bU\.\s?P\.|\bUP\b", "University Press", text)
    words, heads = [], []
    for k, piece in enumerate(_BREAK.split(text)):
        if k:
            heads.append(len(words))
            if words:
                words[-1] += "."
        for w in re.findall(r"[^\W_]+\.?|&", fold_py(piece.replace("-", " "))):
            if w.strip(".") not in ("the", "online"):
                words.append("&" if w.strip(".") in ("and", "und", "u", "et", "&") else spelled(w))
    return (words, [h for h in heads if 0 < h < len(words)]) if words else None


def venue_stem(words: list[str]) -> tuple[str, str]:
    """The stem of a venue's (whole) words, run together, and the words: "Verlag X" is "X Verlag", "University Press of X" is "X University Press"."""
    out = [w.rstrip(".") for w in words]
    if len(out) > 1 and out[0] == "verlag":
        out = [*out[1:], out[0]]
    if out[:3] == ["university", "press", "of"] and len(out) > 3:
        out = [*out[3:], "university", "press"]
    return "".join(out), " ".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    text, many = pa.string(), pa.list_(pa.string())
    types = (pa.int64(), text, pa.int64(), text, text, many, pa.list_(pa.int32()), text, text, text, text)
    for b in batches:
        rows = []
        for name_id, field, form, n in zip(*(b.column(c).to_pylist() for c in range(4))):
            if field == "author":
                if got := read_person(form):
                    kind, stem, s, g, mid = got
                    rows.append((name_id, field, n, kind, stem and f"{field}:{stem}", None, None, s, g[:1], g, mid))
            elif venue := read_venue(form):
                rows.append((name_id, field, n, "venue", None, *venue, "", "", "", ""))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for name_id, field, n, words, heads in zip(*(b.column(c).to_pylist() for c in range(5))):
            stem, s = venue_stem(words)
            rows.append((name_id, field, n, f"{field}:{stem}", s, [f"{field}:{venue_stem(words[:h])[0]}" for h in heads or ()]))
        cols = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["name_id", "field", "n", "stem", "s", "alt"])


def slip(a: str, b: str) -> float:
    """How likely one is the other with one slip of typing; 0 if it isn't: one character too many, missing or another, or two exchanged."""
    if a == b or abs(len(a) - len(b)) > 1:
        return 0.0
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        if a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]:
            return EXCHANGED
        return OTHER if a[k + 1 :] == b[k + 1 :] else 0.0
    if len(a) < len(b):
        a, b = b, a
    if a[k + 1 :] != b[k:]:
        return 0.0
    return DOUBLED if k and a[k] == a[k - 1] else EXTRA


def one_slip(a: str, b: str) -> bool:
    """Do the strings differ by one inserted, dropped or other character, or by two neighbours exchanged?"""
    return slip(a, b) > 0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key with the hashes of itself and of what is left when one character is dropped."""
    for b in batches:
        flat, ends = [], [0]
        for x in b.column(0).to_pylist():
            flat += {xxhash.xxh64_intdigest(x), *(xxhash.xxh64_intdigest(x[:k] + x[k + 1 :]) for k in range(len(x)))}
            ends.append(len(flat))
        signs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint64).view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), signs], names=["x", "signs"])


def _signed(keys: DataFrame, key: str) -> DataFrame:
    """x, signs: the keys with their deletion signatures, cut, since they are looked at from both sides."""
    return cut_large(keys.select(F.col(key).alias("x")).mapInArrow(_signatures, "x string, signs array<long>"), "signatures")


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """x, y, like: keys (x, signs) of the left and of the right side that are one slip apart and likelier so than two names.

    Keys that share a text with one character dropped are candidates; such a text is shared by few keys.
    """
    a, b = left.select("x", F.explode("signs").alias("sign")), right.select(F.col("x").alias("y"), F.explode("signs").alias("sign"))
    return a.join(b, "sign").where("x <> y").select("x", "y").distinct().mapInArrow(_keep_near, "x string, y string, like double")


def _keep_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
        like = []
        for x, y in zip(xs, ys):
            p = slip(x, y)
            letters = sum(ch not in "|" for ch in x.partition(":")[2] or x)
            like.append(p if p * letters >= SLIP_ODDS else 0.0)
        out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like, pa.float64())], names=["x", "y", "like"])
        yield out.filter(pa.array([p > 0 for p in like], pa.bool_()))


def _apart(near: DataFrame, placed: DataFrame) -> DataFrame:
    """``near`` without the pairs of stems that are likelier two entities than one and its slip.

    How often a stem occurs doesn't tell, since a misspelling is copied as often as any form. How many stems have the word
    that differs does: a slip falls on a word once in a while, while a name or word of its own stands in others as well.
    A stem between two such stems explains neither of them, though it may be a slip of one.
    """
    venue = F.col("kind") == "venue"
    words = placed.select("stem", "kind", F.when(venue, F.split("s", " ")).otherwise(F.split(F.regexp_replace("stem", "^[^:]*:", ""), r"\|")).alias("words"))
    words = cut_large(words.groupBy("stem").agg(F.max(F.struct(F.size("words").alias("n"), "words", "kind")).alias("w")).select("stem", "w.words", "w.kind"), "words")
    role = F.concat(F.substring_index("stem", ":", 1), F.when(venue, F.lit("")).otherwise(F.col("i").cast("string")))
    borne = words.select("stem", "kind", F.posexplode("words").alias("i", "word")).select(role.alias("role"), "word", "stem").groupBy("role", "word").agg(F.countDistinct("stem").alias("stems"))
    borne = cut_large(borne.where(F.col("stems") >= OWN_STEMS), "borne")
    both = near.where("x < y").join(words.select(F.col("stem").alias("x"), F.col("words").alias("wx"), "kind"), "x").join(words.select(F.col("stem").alias("y"), F.col("words").alias("wy")), "y")
    other = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("wx") - 1).alias("i"), F.col("wx").alias("a"), F.col("wy").alias("b")), lambda z: z["a"] != z["b"])
    one = both.where("size(wx) = size(wy)").select("x", "y", "kind", F.col("x").alias("stem"), other.alias("d")).where("size(d) = 1").select("x", "y", "kind", "stem", F.col("d")[0]["i"].alias("i"), F.col("d")[0]["a"].alias("a"), F.col("d")[0]["b"].alias("b"))
    known = one.withColumn("role", role).join(borne.select("role", F.col("word").alias("a"), F.col("stems").alias("na")), ["role", "a"]).join(borne.select("role", F.col("word").alias("b"), F.col("stems").alias("nb")), ["role", "b"])
    known = cut_large(known.select("x", "y", "role", "a", "b", "na", "nb"), "known")
    # slips of one common word are one slip apart too, and are as rare as each other
    sides = known.select("role", F.col("a").alias("w"), F.col("na").alias("n"), F.col("nb").alias("m")).unionByName(known.select("role", F.col("b").alias("w"), F.col("nb").alias("n"), F.col("na").alias("m")))
    slips = sides.where(F.col("n") <= SLIP_SHARE * F.col("m")).select("role", "w").distinct().hint("merge")
    two = known.join(slips.withColumnRenamed("w", "a"), ["role", "a"], "left_anti").join(slips.withColumnRenamed("w", "b"), ["role", "b"], "left_anti").select("x", "y")
    two = cut_large(two.unionByName(two.select(F.col("y").alias("x"), F.col("x").alias("y"))), "apart")
    left = cut_large(near.join(two, ["x", "y"], "left_anti"), "left")
    around = two.join(left.select("x", F.col("y").alias("z")), "x").join(left.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    return left.join(around.select(F.col("z").alias("y")).distinct(), "y", "left_anti")


def _roots(stems: DataFrame, parents: DataFrame) -> DataFrame:
    """stem, root: the end of each stem's chain of parents. Parents rank higher, so chains end; each round halves them."""
    at = cut_large(stems.join(parents, "stem", "left").select("stem", F.coalesce("parent", "stem").alias("root")), "roots")
    while True:
        up = at.select(F.col("stem").alias("root"), F.col("root").alias("up"))
        moved = Observation()
        nxt = at.join(up, "root").select("stem", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
        at = cut_large(nxt.observe(moved, F.count_if("moved").alias("n")).select("stem", "root"), "roots")
        if not moved.get["n"]:
            return at


def _only(c: str) -> Column:
    """The value of a group that has a single one, else null."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def _whole_words(venues: DataFrame) -> DataFrame:
    """Venues with their abbreviated words written out: name_id, field, n, words, heads.

    An abbreviation is a word that stands dotted more often than not, or a listed one. It is the word at the same place of a venue that
    is the same otherwise; failing that, what it is most often beside the same neighbour, then at the same end; in doubt it stays.
    """
    words = F.transform("words", lambda w: F.rtrim(w, F.lit(".")))
    rest = F.concat_ws(" ", F.filter(words, lambda w, k: k != F.col("k")))
    tok = venues.select("name_id", "field", "words", F.posexplode("words").alias("k", "w")).select(
        "name_id", "field", "k", F.rtrim(F.col("w"), F.lit(".")).alias("w"), F.col("w").endswith(".").alias("dotted"),
        F.xxhash64("field", "k", rest).alias("ctx"), F.coalesce(F.get(words, F.col("k") + 1), F.get(words, F.col("k") - 1), F.lit("")).alias("by"),
        F.when(F.col("k") == 0, "first").when(F.col("k") == F.size("words") - 1, "last").otherwise("inside").alias("place"),
    )
    tok = cut_large(tok, "tokens")
    vocab = tok.groupBy("field", "w").agg(F.count_if("dotted").alias("nd"), F.count("*").alias("n"))
    listed = venues.sparkSession.createDataFrame([(spelled(a), spelled(w)) for a, w in _pairs_of(SHORT_WORDS)], "a string, w string")
    vocab = cut_large(vocab.join(F.broadcast(listed.select(F.col("a").alias("w"), F.lit(True).alias("listed")).distinct()), "w", "left"), "words")
    short = cut_large(vocab.where("(nd * 2 >= n or listed) and w <> '&'").select("field", F.col("w").alias("a")), "short")
    full = vocab.where("nd * 2 < n and listed is null and length(w) > 2").select("field", "w")
    bones = F.concat(F.left("w", F.lit(1)), F.regexp_replace(F.substr("w", F.lit(2)), "[aeiou]", ""))
    starts = lambda c, least: F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda k: F.left(c, k))
    begun = full.select("field", "w", F.explode(F.array_distinct(F.concat(starts(F.col("w"), 1), starts(bones, 2)))).alias("a")).where("length(a) < length(w)")
    listed = full.join(F.broadcast(listed), "w").select("field", "w", "a")
    means = cut_large(begun.unionByName(listed).distinct().join(short, ["field", "a"]), "means")
    dotted = tok.join(short.withColumnRenamed("a", "w"), ["field", "w"], "left_semi")
    open_ = cut_large(dotted.withColumnRenamed("w", "a").join(means, ["field", "a"]), "open")
    written = tok.join(means.select("field", "w").distinct(), ["field", "w"], "left_semi").select("ctx", "w").distinct()
    hits = cut_large(open_.join(written, ["ctx", "w"]), "hits")
    contexts = cut_large(hits.select("field", "a", "by", "place", "ctx", "w").distinct(), "contexts")
    here = hits.groupBy("name_id", "k").agg(_only("w").alias("here"))

    def most(*keys: str) -> DataFrame:
        seen = contexts.groupBy(*keys, "w").agg(F.count("*").cast("double").alias("n"))
        if keys == ("field", "a", "place"):  # without any such venue, the words that stand there
            there = tok.groupBy("field", "place", "w").agg((F.count("*") / 1e6).alias("n")).join(means, ["field", "w"])
            # and the list, worth half an occurrence anywhere
            known = listed.join(short, ["field", "a"]).select("field", "a", F.explode(F.array(*[F.lit(x) for x in ("first", "inside", "last")])).alias("place"), "w", F.lit(0.5).alias("n"))
            seen = seen.unionByName(there.select(*keys, "w", "n")).unionByName(known).groupBy(*keys, "w").agg(F.sum("n").alias("n"))
        top = seen.groupBy(*keys).agg(F.max(F.struct("n", "w")).alias("top"), F.sum("n").alias("all"))
        return top.where(F.col("top.n") >= ODDS * (F.col("all") - F.col("top.n"))).select(*keys, F.col("top.w").alias("most_" + keys[-1])).hint("merge")

    asked = dotted.withColumnRenamed("w", "a").select("name_id", "field", "k", "a", "by", "place")
    told = asked.join(here, ["name_id", "k"], "left").join(most("field", "a", "by"), ["field", "a", "by"], "left").join(most("field", "a", "place"), ["field", "a", "place"], "left")
    told = told.select("name_id", "k", F.coalesce("here", "most_by", "most_place").alias("to")).where("to is not null").groupBy("name_id").agg(F.collect_list(F.struct("k", "to")).alias("to"))
    put = F.transform("words", lambda w, k: F.coalesce(F.get(F.filter("to", lambda t: t["k"] == k), F.lit(0))["to"], w))
    return venues.join(told, "name_id", "left").select("name_id", "field", "n", F.when(F.col("to").isNull(), F.col("words")).otherwise(put).alias("words"), "heads")


def _short_names(full: DataFrame) -> DataFrame:
    """short, g: which given names short ones may stand for, from the list and from the register.

    ``full``: s, g (surname and given name). A short name begins or ends the full one, but for a diminutive ending. Its
    pairs are formed under a surname by equal beginnings and ends, never by comparing all names of a surname.
    """
    spark = full.sparkSession
    names = cut_large(full.select("s", "g").distinct(), "given")
    per = names.groupBy("g").agg(F.count("*").alias("n"))
    surnames = names.select("s").distinct().count()
    length = F.length("g")
    pieces = F.concat(F.transform(F.sequence(F.lit(2), F.greatest(length - 2, F.lit(2))), lambda k: F.concat(F.lit("^"), F.left("g", k))), F.transform(F.sequence(F.lit(3), F.greatest(length - 1, F.lit(3))), lambda k: F.concat(F.right("g", k), F.lit("$"))))
    whole = names.where("length(g) >= 4").select("s", "g", F.explode(pieces).alias("t"))
    base = F.regexp_replace("g", "(?:ie|chen|lein|[aeiouy])$", "")
    asked = names.where("length(g) <= 7").select("s", F.col("g").alias("short"), F.explode(F.array_distinct(F.array(F.concat(F.lit("^"), "g"), F.concat(F.lit("^"), base), F.concat("g", F.lit("$"))))).alias("t"))
    met = asked.join(whole, ["s", "t"]).where((F.length("short") < F.length("g")) & (F.levenshtein("short", "g") > 1)).select("s", "short", "g").distinct().groupBy("short", "g").agg(F.count("*").alias("both")).where(F.col("both") >= SHORT_SURNAMES)
    met = met.join(per.select(F.col("g").alias("short"), F.col("n").alias("n1")), "short").join(per.select("g", F.col("n").alias("n2")), "g")
    often = F.col("both") * F.lit(surnames) >= SHORT_LIFT * F.col("n1") * F.col("n2")
    learned = met.where(often & (F.col("both") >= SHORT_SHARE * F.col("n1"))).select("short", "g")
    listed = spark.createDataFrame([(spelled(a), spelled(b)) for a, b in _pairs_of(SHORT_NAMES)], "short string, g string")
    both = cut_large(learned.unionByName(listed).distinct(), "short names")
    # of "leo: lenny", "leo: leonard" and "lenny: leonard", the first says no more than the others
    x, y, z = (both.select(F.col("short").alias(a), F.col("g").alias(b)) for a, b in (("p", "q"), ("q", "r"), ("p", "r")))
    over = x.join(y, "q").join(z, ["p", "r"]).select(F.col("p").alias("short"), F.col("q").alias("g")).distinct()
    return cut_large(both.join(over, ["short", "g"], "left_anti"), "short names")


def link_variants(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """The entity of each form: name_id, field, entity (a text that all forms of an entity share).

    ``forms``: name_id, field ('author' for persons, anything else for venues), form. ``counts``: field, form, n, how
    often a form occurs (the prior; forms without a count have 0). Forms that fit two entities equally well, and null
    or empty forms, have no entity and no row; equal forms under several ids are variants of each other.
    """
    rows = forms.select("name_id", "field", "form").where("field is not null and form is not null")
    prior = counts.groupBy("field", "form").agg(F.sum("n").alias("n"))
    known = rows.join(prior.hint("merge"), ["field", "form"], "left").select(F.col("name_id").cast("bigint").alias("name_id"), "field", "form", F.coalesce("n", F.lit(0)).alias("n"))
    read = cut_large(known.distinct().mapInArrow(_read, _READ), "read")  # rows of a form are together after the join

    venues = read.where("kind = 'venue'").select("name_id", "field", "n", "words", "heads")
    venues = cut_large(_whole_words(venues).mapInArrow(_stems, "name_id long, field string, n long, stem string, s string, alt array<string>"), "venues")
    persons = read.where("kind in ('full', 'bare')").select("name_id", "field", "n", "kind", "stem", "s", "i", "g", "mid")
    placed = cut_large(persons.unionByName(venues.select("name_id", "field", "n", F.lit("venue").alias("kind"), "stem", "s", *[F.lit("").alias(c) for c in ("i", "g", "mid")])), "placed")

    # slips: every stem and its likelier neighbours
    stems = cut_large(placed.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms")), "stems")
    signed = _signed(stems, "stem")
    near = cut_large(_apart(cut_large(_near(signed, signed), "slips"), placed), "near")
    # the prior of a candidate is what it would explain: its own occurrences and those of its neighbours
    weight = F.col("n") + F.col("forms")
    explained = near.join(stems.select(F.col("stem").alias("y"), weight.alias("w")), "y").groupBy(F.col("x").alias("stem")).agg(F.sum(F.col("like") * F.col("w")).alias("around"))
    mass = cut_large(explained.join(stems, "stem").select("stem", (F.col("around") + weight).alias("n"), weight.alias("own")), "mass")
    rank = lambda: F.struct("n", "own", "stem")
    ranked = near.join(mass.select(F.col("stem").alias("x"), rank().alias("rx")), "x").join(mass.select(F.col("stem").alias("y"), rank().alias("ry")), "y").where("ry > rx")
    # the posterior: prior times likelihood of the slip
    post = F.struct((F.col("ry.n") * F.col("like")).alias("p"), F.col("ry.own").alias("own"), F.col("ry.stem").alias("stem"))
    best = cut_large(ranked.select(F.col("x").alias("stem"), post.alias("c")).groupBy("stem").agg(F.max("c").alias("best"), F.collect_set("c").alias("all")), "slips")
    roots = _roots(stems.select("stem"), best.select("stem", F.col("best.stem").alias("parent")))
    # a stem whose candidates belong to different entities, none of them clearly likelier, belongs to neither
    rivals = best.select("stem", "best", F.explode("all").alias("c")).where(F.col("c.p") * ODDS >= F.col("best.p"))
    torn = rivals.join(roots.select(F.col("stem").alias("cs"), F.col("root").alias("cr")), F.col("c.stem") == F.col("cs")).groupBy("stem").agg(F.min("cr").alias("a"), F.max("cr").alias("b")).where("a <> b").select("stem").hint("merge")

    # other readings of a stem, where the register has them: the full name of a short one, the title before a subtitle
    full = persons.where("kind = 'full'")
    fuller = full.select("field", "stem", "s", F.col("g").alias("short")).distinct().join(small(_short_names(full), SHORT_ROWS, SHORT_BYTES), "short")
    fuller = fuller.select("stem", F.concat("field", F.lit(":"), "s", F.lit("|"), "g").alias("alt"))
    heads = venues.select("stem", F.explode("alt").alias("alt")).distinct()
    readings = cut_large(fuller.unionByName(heads).where("stem <> alt"), "readings")
    exact = cut_large(readings.join(roots.select(F.col("stem").alias("alt"), "root"), "alt").select("stem", "root"), "exact")
    # with a slip, only where none is there as written
    lost = cut_large(readings.join(exact.select("stem").distinct(), "stem", "left_anti"), "lost")
    slipped = _near(_signed(lost.select("alt").distinct(), "alt"), signed)
    meant = lost.join(slipped.select(F.col("x").alias("alt"), "y"), "alt").join(roots.select(F.col("stem").alias("y"), "root"), "y").select("stem", "root")
    read_as = cut_large(exact.unionByName(meant).where("stem <> root").groupBy("stem").agg(_only("root").alias("as"), F.lit(True).alias("asked")), "read as")
    # a stem goes where its own reading leads, else where that of its root does; one of several readings goes nowhere
    of_root = read_as.select(F.col("stem").alias("root"), F.col("as").alias("as_root"), F.col("asked").alias("asked_root"))
    to = roots.join(read_as, "stem", "left").join(of_root, "root", "left")
    to = to.select("stem", F.when(F.col("asked"), F.col("as")).when(F.col("asked_root"), F.col("as_root")).otherwise(F.col("root")).alias("root"))
    to = to.join(of_root, "root", "left").select("stem", F.coalesce("as_root", "root").alias("root"))
    rooted = cut_large(placed.join(to.where("root is not null"), "stem").join(torn, "stem", "left_anti"), "rooted")

    # middle initials: one per entity; with several, a form without one fits them all
    middles = rooted.where("mid <> ''").groupBy("root").agg(F.min("mid").alias("m1"), F.max("mid").alias("m2"))
    split = F.col("m1") != F.col("m2")
    entity = F.when(F.coalesce(~split, F.lit(True)), F.col("root")).when(F.col("mid") != "", F.concat("root", F.lit("|"), "mid"))
    whole = cut_large(rooted.join(middles, "root", "left").select("name_id", "field", "kind", "s", "i", "mid", "root", "m1", entity.alias("entity"), split.alias("split")), "whole")

    # initials: the entities under a surname and initial, by middle initial
    own_mid = F.when(F.coalesce("split", F.lit(False)), F.col("mid")).otherwise(F.coalesce("m1", F.lit("")))
    root_s = F.regexp_extract("root", r"^[^:]*:([^|]*)\|", 1)
    persons = whole.where("kind = 'full' and entity is not null").withColumn("own", own_mid)
    under = cut_large(persons.select("entity", "own", "i", F.explode(F.array_distinct(F.array("s", root_s))).alias("s")).select("s", "i", "own", "entity").distinct(), "under")
    init = read.where("kind = 'init'").select("name_id", "field", "s", "i", "mid")
    heads = init.select("s", "i").distinct()
    # surnames with a slip: only where the surname as written has nobody under this initial
    lost = heads.join(under, ["s", "i"], "left_anti").select(F.concat("s", F.lit("|"), "i").alias("k"))
    there = under.select(F.concat("s", F.lit("|"), "i").alias("k")).distinct()
    slips = _near(_signed(lost, "k"), _signed(there, "k"))
    moved = slips.groupBy("x").agg(_only("y").alias("y")).where("y is not null")
    key = F.concat("s", F.lit("|"), "i")
    at = init.withColumn("x", key).join(moved, "x", "left").withColumn("k", F.coalesce("y", "x")).drop("x", "y")
    # initials with a middle initial that no full name has stand for a person of their own
    by_mid = under.groupBy(key.alias("k"), F.col("own").alias("mid")).agg(_only("entity").alias("one"), F.lit(True).alias("some"))
    none_mid = by_mid.where("mid = ''").select("k", F.col("one").alias("plain"), F.lit(True).alias("has_plain"))
    fit = at.join(by_mid, ["k", "mid"], "left").join(none_mid, "k", "left")
    named = F.when(F.col("some"), F.col("one")).when(F.col("has_plain"), F.col("plain")).otherwise(F.concat(F.lit("author:"), F.col("k"), F.lit(".|"), F.col("mid")))
    with_mid = cut_large(fit.where("mid <> ''").select("name_id", "field", "k", named.alias("entity")), "initials")
    all_k = under.select(key.alias("k"), "entity").unionByName(with_mid.where("entity is not null").select("k", "entity")).groupBy("k").agg(_only("entity").alias("one"), F.lit(True).alias("some")).hint("merge")
    without = at.where("mid = ''").join(all_k, "k", "left").select("name_id", "field", F.when(F.col("some"), F.col("one")).otherwise(F.concat(F.lit("author:"), F.col("k"), F.lit("."))).alias("entity"))
    return whole.select("name_id", "field", "entity").unionByName(with_mid.select("name_id", "field", "entity")).unionByName(without).where("entity is not null")


def variant_pairs(links: DataFrame) -> DataFrame:
    """All pairs of forms of one entity: name_id_a < name_id_b.

    Pairs come from a join of the members with themselves, so the pairs of a large entity are spread over the tasks of
    its first members: its rows are salted by id on the one side and repeated per salt on the other.
    """
    salts = 16
    member = cut_large(links.select(F.xxhash64("field", "entity").alias("e"), F.xxhash64("entity", "field").alias("f"), "name_id").distinct(), "members")
    sizes = member.groupBy("e", "f").agg(F.count("*").alias("n")).where("n > 1").select("e", "f", F.when(F.col("n") > 1000, F.lit(salts)).otherwise(F.lit(1)).alias("salts"))
    sized = member.join(sizes, ["e", "f"])
    a = sized.select("e", "f", F.col("name_id").alias("name_id_a"), F.pmod(F.xxhash64("name_id"), F.col("salts")).cast("int").alias("salt"))
    b = sized.select("e", "f", F.col("name_id").alias("name_id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b.hint("merge"), ["e", "f", "salt"]).where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
