"""Several values packed in one field: segmentation by expectation-maximisation and Viterbi lattices.

A cell is first read into parts by what leaves no choice: quoted spans (atomic), strong delimiters, list numbers and
notes. What is left open, a part with commas, slashes or conjunctions that may or may not separate values, is a
lattice of all its stretches. The model is learned from the whole column: how often each value occurs, which shapes
values have, and how often each kind of delimiter separates. It starts from the parts that leave no choice and is
refined by forward-backward passes over the open ones until the likelihood stands still; Viterbi then gives the
segmentation. The passes run in numpy over all parts of a batch that have as many stretches; values are known by a hash
of their pieces, so no stretch is ever written out.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubscope.functions.names import PARTICLES
from pubscope.session import cut

# Notes that are no names.
ROLES = r"(?:eds?|hgg?|hrsg|hgs|hgb|dir|dirs|éds?|coord|coords|trans|transl|translator|trad|übers|comp|comps|editor|editors|herausgeber|herausgeberin|contributor|red|a\. ?o|u\. ?a|u\.a|et\.? ?al)"

_NOTE = re.compile(rf"\s*[(\[]\s*{ROLES}\.?\s*[)\]]", re.I)
_OTHERS = re.compile(r"[\s,]*(?:\bet\.?\s?al\b\.?|\bu\.\s?a\.|\bu\.\s?v\.\s?a\.|\b(?:and|und|et|&)\s+(?:others?|andere|autres|al\.?)\b|\ba\.\s?o\.|…|\.\.\.)[\s,]*$", re.I)
_ROLE_END = re.compile(r",\s*(?:eds?|hgg?|hrsg)\.?\s*$", re.I)
_OTHERS_HINT, _ROLE_HINT = ("al", "a.", "andere", "autres", "other", "o.", "…", "..."), ("ed", "hg", "hrsg")
# Delimiters that always separate outside of quotes, and those that may.
_STRONG = re.compile(r"[;；؛、|•·\n\r\t\x85  ]+|//+|(?:^|(?<=\s))\(\d{1,3}\)|(?:^|(?<=\s))\d{1,3}[.)](?=\s)")
_WEAK = re.compile(r"\s*,\s*(?:(?:and|und|et|&)\s+)?|\s+(?:and|und|et|&)\s+|\s*/\s*|\s*&\s*")
_LEAD = re.compile(r"^(?:[\s,/&]|(?:and|und|et)\s)+")
_TAIL = re.compile(r"(?:[\s,/&]|\s(?:and|und|et))+$")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"(?!")|“([^”]*)”|„([^“”]*)[“”]|«([^»]*)»')
_OPENING = re.compile(r"[\s,;；|/•·\t\n(\[&]$|(?:^|\s)(?:and|und|et)\s$")
_CLOSING = re.compile(r"[\s,;；|/•·)\]&]")

# Weights of what was believed before: for shapes, and for values not seen elsewhere (as a share of all values).
PRIOR = 50.0
NEW_VALUES = 0.1
START_SPLIT = {",": 0.5, ",&": 0.95, "&": 0.8, "w&": 0.2, "/": 0.9}

#: A shape of more words than this is known by its kind; each further word makes it this much less likely.
LONG_SHAPE, LONGER = 14, 0.6
#: The passes end when the log-likelihood of the column moves by no more than this share.
STILL = 1e-3

_PARTS = "row long, id long, part_no int, open boolean, part string"
_LATTICE = "part string, n long, p long, h array<long>, e array<double>, k array<string>, x array<double>"


def tidy(name: str) -> str:
    """A value as it is given out: no outer blanks, exactly one space after a comma."""
    return re.sub(r",\s*", ", ", name).strip(" \t\r\n\xa0​﻿,").strip()


def bare(text: str) -> str:
    """Without notes of role or further persons, and without the delimiters this leaves at the ends."""
    before = None
    while text != before:
        before = text
        # what a pattern can't do without is looked for first
        if "(" in text or "[" in text:
            text = _NOTE.sub("", text)
        end = text[-24:].lower()
        if any(x in end for x in _OTHERS_HINT):
            text = _OTHERS.sub("", text)
        if any(x in end for x in _ROLE_HINT):
            text = _ROLE_END.sub("", text)
        text = _TAIL.sub("", _LEAD.sub("", text)).strip()
    return text


def read_cell(cell: str | None) -> list[tuple[bool, str]]:
    """The parts of a cell in order: (open, text). Parts that are not open are values."""
    if cell is None or not cell.strip():
        return []
    stripped = cell.strip()
    if stripped[:1] == "[" and stripped[-1:] == "]" and '"' in stripped:
        try:
            values = json.loads(stripped)
        except ValueError:
            values = None
        if isinstance(values, list) and all(isinstance(v, str) for v in values):
            return [(False, t) for t in (tidy(bare(v)) for v in values) if t]
    held: list[str] = []

    def hold(m: re.Match) -> str:
        inner = next(g for g in m.groups() if g is not None).replace('""', '"')
        before, after = cell[: m.start()], cell[m.end() : m.end() + 1]
        if (before and not _OPENING.search(before)) or (after and not _CLOSING.match(after)):
            return m.group()
        held.append(inner)
        return f"{len(held) - 1}"

    masked = _QUOTED.sub(hold, cell) if any(q in cell for q in '"“„«') else cell
    out: list[tuple[bool, str]] = []

    def plain(text: str) -> None:
        text = bare(text)
        if any(ch.isalnum() for ch in text):
            is_open = bool(_WEAK.search(text))
            out.append((True, re.sub(r",\s*", ", ", text)) if is_open else (False, tidy(text)))

    for segment in _STRONG.split(masked):
        if not segment or not segment.strip():
            continue
        at = 0
        marks = list(re.finditer("(\\d+)", segment))
        for m in marks:
            left, right = bare(segment[at : m.start()]), _NOTE.sub("", segment[m.end() :])
            # text that touches the quoted span with no delimiter between belongs to one name with it
            joined_left = left and not re.search(r"(?:[,/&]|\s(?:and|und|et))\s*$", _NOTE.sub("", segment[at : m.start()]))
            if joined_left or (right.strip() and not re.match(r"\s*(?:[,/&]|(?:and|und|et|u\.)\s|et\.?\s?al|[(\[]|)", right)):
                continue
            if left:
                plain(segment[at : m.start()])
            if value := tidy(held[int(m.group(1))]):
                out.append((False, value))
            at = m.end()
        rest = re.sub("(\\d+)", lambda m: f'"{held[int(m.group(1))]}"', segment[at:])
        plain(rest)
    return out


def atoms(part: str) -> tuple[list[str], list[str], list[str]]:
    """The stretches of an open part, the delimiters between them as written, and their kinds."""
    words, between, kinds, at = [], [], [], 0
    for m in _WEAK.finditer(part):
        if m.start() == 0 or m.end() == len(part):
            continue
        words.append(part[at : m.start()])
        text = m.group()
        kind = (",&" if re.search(r"and|und|et|&", text) else ",") if "," in text else "/" if "/" in text else "&"
        # a conjunction after a lower-case word more often belongs to the name of a body
        kinds.append("w&" if kind == "&" and any(w[:1].islower() and w.lower() not in PARTICLES and not w.startswith("al-") for w in words[-1].split()) else kind)
        between.append(text)
        at = m.end()
    words.append(part[at:])
    return words, between, kinds


@lru_cache(100_000)
def symbols(value: str) -> str:
    """The build of a value or a delimiter: kinds of its words and the marks between them."""
    out = []
    for w in re.findall(r"[^\s,/&]+|[,/&]", value):
        if w in ",/&":
            out.append(w)
        elif w in ("and", "und", "et"):
            out.append("&")
        elif w.lower().strip(".") in PARTICLES or w.lower().startswith("al-"):
            out.append("p" if "-" not in w else "C")
        elif re.fullmatch(r"(?:\w\.-?)+", w):
            out.append("I")
        elif w.endswith("."):
            out.append("A")
        elif w[:1].islower():
            out.append("w")
        elif any(ch.isdigit() for ch in w):
            out.append("N")
        else:
            out.append("C")
    return " ".join(out)


@lru_cache(100_000)
def shape_of(built: str) -> tuple[str, int]:
    """The shape that stands for a build, and how many words it is over the longest shape."""
    k = built.count(" ") + 1
    if k <= LONG_SHAPE:
        return built, 0
    return ("body" if set("w&/") & set(built) else "long"), k - LONG_SHAPE


@lru_cache(100_000)
def prior(shape: str) -> float:
    """How likely a shape is before anything was seen."""
    if shape in ("body", "long"):
        return 0.05 * 0.6**LONG_SHAPE if shape == "body" else 1e-9 * 0.2**LONG_SHAPE
    k = shape.count(" ") + 1
    if re.fullmatch(r"(?:p )*C ,(?: C| I)+(?: p)*", shape):
        return 0.45 * 0.4 ** max(0, k - 3)
    if re.fullmatch(r"(?:p )*C C ,(?: C| I)+", shape):
        return 0.004 * 0.4 ** (k - 4)
    if re.fullmatch(r"(?:C|I)(?: C| I| p)* C", shape):
        return 0.3 * 0.4 ** max(0, k - 2)
    if k == 1:
        return 0.002 if shape == "C" else 1e-6
    if re.fullmatch(r"(?:C|N).*", shape) and ("w" in shape or "&" in shape or "/" in shape):
        return 0.05 * 0.6**k
    if shape.count(",") > 1:
        return 1e-9 * 0.2**k  # several names rather than one
    return 1e-3 * 0.2**k


class Model:
    """Probabilities of values and delimiters. Its tables of shapes and delimiters are bounded and travel with the code."""

    def __init__(self, stats: dict[str, float]) -> None:
        self.shapes = {k[2:]: v for k, v in stats.items() if k.startswith("s:")}
        self.total = sum(self.shapes.values())
        self.split = {}
        for kind, start in START_SPLIT.items():
            yes, no = stats.get(f"d:{kind}:1", 0.0), stats.get(f"d:{kind}:0", 0.0)
            self.split[kind] = min(0.999, max(0.001, (yes + 10 * start) / (yes + no + 10)))
        self.keep = {k: math.log(1 - p) for k, p in self.split.items()}
        self.cut = {k: math.log(p) for k, p in self.split.items()}

        self.logs: dict[str, float] = {}

    def shape(self, built: str) -> float:
        """Log probability of a value's build."""
        if (got := self.logs.get(built)) is None:
            shape, more = shape_of(built)
            # a long shape stands for many, so what was seen of them says nothing about one
            seen = self.shapes.get(shape, 0.0) if not more else 0.0
            got = math.log((seen + PRIOR * prior(shape)) / (self.total + PRIOR)) + more * math.log(LONGER)
            if len(self.logs) < 1_000_000:  # a memo
                self.logs[built] = got
        return got

    def values(self, shape: np.ndarray, words: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Log probabilities of values by their builds, numbers of words, and how often each occurs elsewhere."""
        new = max(100.0, NEW_VALUES * self.total)
        # the words' own probabilities: the same in every segmentation, but not beside the count of a seen value
        unseen = math.log(new) + shape + words * math.log(min(0.01, 100.0 / (self.total + 1)))
        with np.errstate(divide="ignore"):
            known = np.log(np.where(seen > 1e-9, seen, 0.0))
        return np.logaddexp(known, unseen) - math.log(self.total + new)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def hash_of(value: str) -> int:
    """The hash by which a value is known, as a signed number: that of the stretch with the same pieces."""
    words, between, _ = atoms(value)
    h = 0
    for k, w in enumerate(words):
        for t in ([between[k - 1]] if k else []) + [w]:
            h = (h * int(_BASE) + (xxhash.xxh64_intdigest(t) | 1)) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


class Lattices:
    """The stretches of a batch of parts, as matrices for all parts with the same number m of pieces.

    Stretch (i, j) has the number of pairs before it in the order of i, then j; the stretches of part r begin at off[r].
    """

    def __init__(self, parts: list[str]) -> None:
        read = [atoms(p) for p in parts]
        m = np.array([len(w) for w, _, _ in read], np.int64)
        self.size = m * (m + 1) // 2
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.read = read
        self.classes = [(int(k), np.flatnonzero(m == k)) for k in np.unique(m)]

    def hashes(self) -> np.ndarray:
        out = np.empty(int(self.off[-1]), np.uint64)
        with np.errstate(over="ignore"):
            for m, rows in self.classes:
                tokens = np.ones((len(rows), 2 * m - 1), np.uint64)
                for a, r in enumerate(rows):
                    words, between, _ = self.read[r]
                    tokens[a, 0::2] = [xxhash.xxh64_intdigest(w) | 1 for w in words]
                    tokens[a, 1::2] = [xxhash.xxh64_intdigest(b) | 1 for b in between]
                head = np.zeros((len(rows), 2 * m), np.uint64)
                for k in range(2 * m - 1):
                    head[:, k + 1] = head[:, k] * _BASE + tokens[:, k]
                power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * m - 1, _BASE)]))
                at = 0
                for i in range(m):
                    j = np.arange(i, m)
                    out[self.off[rows][:, None] + at + j - i] = head[:, 2 * j + 1] - head[:, [2 * i]] * power[2 * j + 1 - 2 * i]
                    at += m - i
        return out.view(np.int64)

    def weights(self, model: Model, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[list[str]]]]:
        """Per class: m, its rows, log cut weights at each end, log weights of the stretches from each i, their builds."""
        for m, rows in self.classes:
            n = len(rows)
            shape, builds = np.empty((n, m * (m + 1) // 2)), []
            words = np.empty((n, m + 1))
            keep, cut_at = np.zeros((n, m)), np.zeros((n, m + 1))
            words[:, 0] = 0
            for a, r in enumerate(rows):
                pieces, between, kinds = self.read[r]
                sym = [symbols(w) for w in pieces]
                joint = [symbols(b) for b in between]
                mine = []
                for i in range(m):
                    built = sym[i]
                    mine.append(built)
                    for j in range(i + 1, m):
                        built = f"{built} {joint[j - 1]} {sym[j]}"
                        mine.append(built)
                builds.append(mine)
                shape[a] = [model.shape(b) for b in mine]
                words[a, 1:] = np.cumsum([sum(t not in ("/", "&", "and", "und", "et") for t in w.split()) for w in pieces])
                keep[a, 1:] = np.cumsum([model.keep[k] for k in kinds])
                cut_at[a, 1:m] = [model.cut[k] for k in kinds]
            at, out = 0, []
            for i in range(m):
                cols = slice(at, at + m - i)
                elsewhere = seen[self.off[rows][:, None] + np.arange(cols.start, cols.stop)]
                value = model.values(shape[:, cols], words[:, i + 1 :] - words[:, [i]], elsewhere)
                out.append(value + keep[:, i:] - keep[:, [i]])
                at = cols.stop
            yield m, rows, cut_at, out, builds


def forward_backward(m: int, cut_at: np.ndarray, weights: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The probability that each stretch is one of the values, and the log-likelihood of each part."""
    n = len(cut_at)
    f, b = np.full((n, m + 1), -np.inf), np.full((n, m + 1), -np.inf)
    f[:, 0] = b[:, m] = 0.0
    for i in range(m):  # stretches come by start, so every earlier end is complete
        f[:, i + 1 :] = np.logaddexp(f[:, i + 1 :], f[:, [i]] + weights[i] + cut_at[:, i + 1 :])
    for i in reversed(range(m)):
        b[:, i] = np.logaddexp.reduce(weights[i] + cut_at[:, i + 1 :] + b[:, i + 1 :], axis=1)
    whole = f[:, [m]]
    return [np.exp(np.minimum(0.0, f[:, [i]] + weights[i] + cut_at[:, i + 1 :] + b[:, i + 1 :] - whole)) for i in range(m)], whole[:, 0]


def viterbi(m: int, cut_at: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """For each part and end, where the likeliest last value before it begins; on a tie the way with fewer values."""
    n = len(cut_at)
    best, count, start = np.full((n, m + 1), -np.inf), np.zeros((n, m + 1), np.int64), np.zeros((n, m + 1), np.int64)
    best[:, 0] = 0.0
    for i in range(m):
        here, values = best[:, [i]] + weights[i] + cut_at[:, i + 1 :], count[:, [i]] + 1
        better = (here > best[:, i + 1 :]) | ((here == best[:, i + 1 :]) & (values < count[:, i + 1 :]))
        best[:, i + 1 :] = np.where(better, here, best[:, i + 1 :])
        count[:, i + 1 :] = np.where(better, values, count[:, i + 1 :])
        start[:, i + 1 :] = np.where(better, i, start[:, i + 1 :])
    return start


def segment(pieces: list[str], between: list[str], start: np.ndarray) -> list[str]:
    """The values that the starts lead to."""
    out, at = [], len(pieces)
    while at > 0:
        i = int(start[at])
        out.append(tidy("".join(w + (between[k] if k + 1 < at else "") for k, w in enumerate(pieces[i:at], i))))
        at = i
    return [v for v in reversed(out) if v]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r, d, i, o, t) for r, d, cell in zip(*(b.column(c).to_pylist() for c in range(3))) for i, (o, t) in enumerate(read_cell(cell))]
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row", "id", "part_no", "open", "part"])


def _occurrences(b: pa.RecordBatch, lat: Lattices, held: bool) -> np.ndarray:
    """How often the value of each stretch occurs elsewhere: as counted, less what the part itself was counted for."""
    seen = np.zeros(int(lat.off[-1]))
    if not held:
        return seen
    found, own = b.column("seen"), b.column("e")
    sizes = np.diff(found.offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
    flat = found.flatten()
    if len(flat):
        valid = found.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.flatnonzero(valid), sizes[valid])
        c = flat.field("c").to_numpy(zero_copy_only=False)
        n = flat.field("n").to_numpy(zero_copy_only=False)
        ok = c < lat.size[rows]
        seen[lat.off[rows[ok]] + c[ok]] = n[ok]
    e = own.flatten().to_numpy(zero_copy_only=False)
    times = np.repeat(b.column("n").to_numpy(zero_copy_only=False), lat.size)
    return np.maximum(seen - np.where(e >= times / 2, e, 0.0), 0.0)


def _lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows that the matrices of their stretches stay small."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            yield b.slice(at, 2000)


def _expect(stats: dict[str, float], held: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forward-backward over open parts. ``held``: the rows bring the earlier expectations and what is seen elsewhere.

    The sums for the model come once per batch, with its first row.
    """
    text, num = pa.list_(pa.string()), pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(stats)
        for b in _slices(batches):
            parts = b.column("part").to_pylist()
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            lat = Lattices(parts)
            e_all = np.zeros(int(lat.off[-1]))
            sums: dict[str, float] = {}
            total = 0.0
            for m, rows, cut_at, weights, builds in lat.weights(model, _occurrences(b, lat, held)):
                e, like = forward_backward(m, cut_at, weights)
                total += float((n[rows] * like).sum())
                inside = np.zeros((len(rows), max(m - 1, 0)))
                for i in range(m - 1):
                    inside[:, i:] += np.cumsum(e[i][:, :0:-1], axis=1)[:, ::-1]
                flat = np.concatenate(e, axis=1) * n[rows, None]
                e_all[lat.off[rows][:, None] + np.arange(flat.shape[1])] = flat
                for a, r in enumerate(rows):
                    for built, x in zip(builds[a], flat[a].tolist()):
                        if x > 1e-9:
                            key = "s:" + shape_of(built)[0]
                            sums[key] = sums.get(key, 0.0) + x
                    for kind, x in zip(lat.read[r][2], inside[a].tolist()):
                        sums[f"d:{kind}:0"] = sums.get(f"d:{kind}:0", 0.0) + n[r] * x
                        sums[f"d:{kind}:1"] = sums.get(f"d:{kind}:1", 0.0) + n[r] * (1 - x)
            sums["ll"] = total
            off = lat.off.astype(np.int32)
            h = b.column("h") if held else _lists(lat.hashes(), off, pa.int64())
            first = [list(sums)] + [None] * (b.num_rows - 1) if b.num_rows else []
            value = [list(sums.values())] + [None] * (b.num_rows - 1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("n"), b.column("p"), h, _lists(e_all, off, pa.float64()), pa.array(first, text), pa.array(value, num)], names=["part", "n", "p", "h", "e", "k", "x"]
            )

    return run


def _decide(stats: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(stats)
        for b in _slices(batches):
            lat = Lattices(b.column("part").to_pylist())
            values: list[list[str]] = [[]] * b.num_rows
            for m, rows, cut_at, weights, _ in lat.weights(model, _occurrences(b, lat, True)):
                start = viterbi(m, cut_at, weights)
                for a, r in enumerate(rows):
                    values[r] = segment(*lat.read[r][:2], start[a])
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(values, pa.list_(pa.string()))], names=["part", "vals"])

    return run


def _seed_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = ["s:" + shape_of(symbols(v))[0] for v in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(1).cast(pa.float64())], names=["k", "e"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = [hash_of(v) for v in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(1).cast(pa.float64())], names=["h", "c"])


def _table(stats: DataFrame) -> dict[str, float]:
    """Sums per key. The keys are shapes (of at most 14 word kinds) and delimiter kinds; what the driver reads is bounded by them."""
    return {r["k"]: r["e"] for r in stats.groupBy("k").agg(F.sum("e").alias("e")).collect()}


def unpack(rows: DataFrame, id_col: str, cell_col: str, value_col: str, still: float = STILL) -> DataFrame:
    """Every value of a packed cell on its own row: id, pos (from 1 in its cell), value.

    Null, empty and blank cells, empty places and cells of delimiters alone give no rows; a cell without delimiters is
    one value; repeated ids and repeated values come as often as they are written. Values keep their spelling, without
    outer blanks, enclosing quotes (doubled inner ones become single), list numbers and notes of role or of further
    persons; a comma inside of a value is followed by one space.

    Cells are read where they are, in one pass. The lattices are those of the distinct open parts, so a part that
    fills a third of the column is one row with a count. Value frequencies are joined by hash, never broadcast; the
    driver sees only the sums per shape and per delimiter. A value is judged by its occurrences elsewhere: what a part
    itself contributed is taken off. The passes end when the log-likelihood moves by no more than the share ``still``.
    """
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(cell_col).cast("string").alias("cell"))
    parts = cut(keyed.where("cell is not null").mapInArrow(_read, _PARTS), "parts")
    fixed = cut(parts.where("not open").groupBy(F.col("part").alias("v")).agg(F.count("*").alias("n")), "values")
    stats = _table(fixed.mapInArrow(_seed_stats, "k string, e double"))
    seeds = dict(stats)
    sure = cut(fixed.mapInArrow(_hashed, "h long, c double"), "hashes")
    distinct = parts.where("open").groupBy("part").agg(F.count("*").alias("n")).withColumn("p", F.xxhash64("part"))
    current = cut(distinct.mapInArrow(_expect(stats, False), _LATTICE), "lattice")
    before: float | None = None
    while True:
        moved = _table(current.where("k is not null").select(F.explode(F.arrays_zip(F.col("k"), F.col("x").alias("e"))).alias("s")).select("s.k", "s.e"))
        like = moved.pop("ll", 0.0)
        stats = {k: seeds.get(k, 0.0) + moved.get(k, 0.0) for k in seeds.keys() | moved.keys()}
        # half-beliefs don't count as occurrences: otherwise "A for B" gathers them from every "A for B and C"
        likely = F.filter(F.arrays_zip("h", "e"), lambda x: x["e"] >= F.col("n") / 2)
        counts = current.select(F.explode(likely).alias("x")).select("x.h", F.col("x.e").alias("c")).unionByName(sure).groupBy("h").agg(F.sum("c").alias("c"))
        seen = current.select("p", F.posexplode("h").alias("k", "h")).join(counts, "h").groupBy("p").agg(F.collect_list(F.struct(F.col("k").alias("c"), F.col("c").alias("n"))).alias("seen"))
        held = current.select("part", "n", "p", "h", "e").join(seen, "p", "left")
        if before is not None and abs(like - before) <= still * abs(like):
            break
        # the first pass knew no values yet, so its likelihood is not compared
        before = like if before is not None else math.inf
        current = cut(held.mapInArrow(_expect(stats, True), _LATTICE), "lattice")
    decided = cut(held.mapInArrow(_decide(stats), "part string, vals array<string>"), "decided")
    opened = parts.where("open").join(decided, "part").select("row", "id", "part_no", "vals")
    closed = parts.where("not open").select("row", "id", "part_no", F.array("part").alias("vals"))
    # a cell's parts come together again; parts of a cell are bounded by the cell's length
    cell = opened.unionByName(closed).groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("part_no", "vals"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["vals"]))
    return cell.select("id", F.posexplode(flat).alias("pos", "v")).select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("pos"), F.col("v").alias(value_col))
