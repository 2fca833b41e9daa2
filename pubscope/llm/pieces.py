"""Splitting oversized texts at natural boundaries, by content-defined landmarks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubscope.llm.encoder import MEMO, PRE_TOKEN, Encoder, encoder, vocabulary
from pubscope.session import small

#: Units that the rolling hash covers.
WINDOW = 8
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: A pre-token of more tokens than this may be cut inside, at characters.
LONG_UNIT = 16

_SCHEMA = "doc_id long, source string, piece_no int, n_pieces int, char_start int, char_end int, n_tokens int, overlap_tokens int, text string"

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0

# Kinds of characters, as bits of a table.
_BLANK, _NEWLINE, _ENDER, _CLOSER, _CLAUSE, _WIDE_ENDER, _WIDE = 1, 2, 4, 8, 16, 32, 64
_KINDS = {
    _BLANK | _NEWLINE: "\n\r\x85\u2028\u2029",
    _BLANK: "\t\x0b\x0c \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
    _ENDER: ".!?…؟।",
    _ENDER | _WIDE_ENDER: "。！？",
    _CLOSER: "\"')]}»”’",
    _CLAUSE: ",;:–—",
    _CLAUSE | _WIDE: "、，；：",
}
_TABLE = np.zeros(0x10000, np.uint8)
for _bits, _chars in _KINDS.items():
    for _c in _chars:
        _TABLE[ord(_c)] |= _bits


def kinds_of(text: str) -> np.ndarray:
    """The kind bits of each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(c, 0xFFFF)]


def _last(mask: np.ndarray) -> np.ndarray:
    """For each offset, the offset after the last character before it that is in the mask (0 without one)."""
    out = np.zeros(len(mask) + 1, np.int64)
    at = np.flatnonzero(mask) + 1
    out[at] = at
    return np.maximum.accumulate(out)


def levels(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How natural a cut is after each of the character offsets ``ends`` of a text with these kinds of characters."""
    blank = (kind & _BLANK) > 0
    prev, nxt = kind[ends - 1], np.append(kind, np.uint8(_BLANK))[ends]
    after_blank, before_blank = (prev & _BLANK) > 0, (nxt & _BLANK) > 0
    # newlines in the run of blanks that ends at an offset
    total = np.concatenate([[0], np.cumsum((kind & _NEWLINE) > 0)])
    breaks = total[ends] - total[_last(~blank)[ends]]
    # the last character that isn't a closing mark
    core = _last((kind & _CLOSER) == 0)[ends]
    ended = ((kind[np.maximum(core - 1, 0)] & _ENDER) > 0) & (core > 0)
    out = np.where(after_blank | before_blank, WORD, INSIDE)
    out = np.where(((prev & _CLAUSE) > 0) & (before_blank | ((prev & _WIDE) > 0)), CLAUSE, out)
    out = np.where(ended & (before_blank | ((prev & _WIDE_ENDER) > 0)), SENTENCE, out)
    out = np.where(after_blank & (breaks == 1), LINE, out)
    return np.where(after_blank & (breaks > 1), PARAGRAPH, out)


class Memo(dict):
    """Tokens and hash of pre-tokens, packed in one number: what is asked for again is not encoded again."""

    def __init__(self, enc: Encoder) -> None:
        self.enc = enc

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        got = min(self.enc.count(word), 2**30) << 32 | zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = got
        return got


def units(enc: Encoder, text: str, longest: int = LONG_UNIT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends (character offsets), tokens and hashes of the smallest pieces, and which of them end inside of a pre-token.

    These are pre-tokens, or the parts of very long ones, cut where tokens and characters end together.
    """
    if not hasattr(enc, "memo"):
        enc.memo = Memo(enc)  # type: ignore[attr-defined]
    words = PRE_TOKEN.findall(text)
    packed = np.fromiter(map(enc.memo.__getitem__, words), np.int64, len(words))  # type: ignore[attr-defined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    tokens, hashes, inside = packed >> 32, (packed & 0xFFFFFFFF).astype(np.uint64), np.zeros(len(words), bool)
    out: list[tuple] = []
    done = 0
    for k in np.flatnonzero(tokens > longest):
        word, start = words[k], int(ends[k]) - len(words[k])
        raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
        starts = (raw & 0xC0) != 0x80
        chars = np.cumsum(starts)
        sizes = np.cumsum([len(enc.bpe.decode_single_token_bytes(i)) for i in enc.ids(word).tolist()])
        whole = (sizes == len(raw)) | starts[np.minimum(sizes, len(raw) - 1)]
        part_ends, held = chars[sizes[whole] - 1], np.diff(np.concatenate([[0], np.flatnonzero(whole) + 1]))
        cuts = np.concatenate([[0], part_ends])
        marks = [zlib.crc32(word[x:y].encode("utf-8", "surrogatepass")) for x, y in zip(cuts[:-1], cuts[1:])]
        out.append((ends[done:k], tokens[done:k], hashes[done:k], inside[done:k]))
        out.append((part_ends + start, held, np.array(marks, np.uint64), np.arange(len(part_ends)) < len(part_ends) - 1))
        done = k + 1
    if out:
        out.append((ends[done:], tokens[done:], hashes[done:], inside[done:]))
        ends, tokens, hashes, inside = (np.concatenate(x) for x in zip(*out))
    return ends, tokens, hashes, inside


def rolling(hashes: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW units at each unit."""
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(1)
        for j in range(min(WINDOW, len(hashes))):
            out[j:] += (hashes[: len(hashes) - j] + np.uint64(1)) * factor
            factor = factor * _PRIME
        out ^= out >> np.uint64(29)
        return out * _PRIME


def snap(landmark: int, lo: int, hi: int, level: np.ndarray, near: int, cum: np.ndarray) -> int:
    """The natural boundary for a landmark among units lo..hi: a paragraph or line end near by, else the nearest sentence, clause, word end."""
    window = level[lo : hi + 1]
    dist = np.abs(cum[lo + 1 : hi + 2] - cum[landmark + 1])
    for least, reach in ((LINE, near), (SENTENCE, None), (CLAUSE, None), (WORD, None), (INSIDE, None)):
        ok = np.flatnonzero((window >= least) & (dist <= reach if reach is not None else True))
        if len(ok):
            return lo + int(ok[np.argmin(dist[ok])])
    return landmark


def split(enc: Encoder, text: str, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start, end, tokens, overlap with the one before) of a text; none if it doesn't exceed ``most`` tokens.

    Every piece has at most ``most`` tokens when encoded by itself; the overlap is the fewest whole words that have
    ``overlap`` tokens, of which a piece can share all but one. Each piece goes on beyond the one before. The only exception is a single character that has more tokens than ``most``.
    """
    ends, tokens, hashes, inside = units(enc, text, min(LONG_UNIT, max(1, most // 8)))
    cum = np.concatenate([[0], np.cumsum(tokens)])
    if cum[-1] <= most:
        return []
    overlap = max(0, min(overlap, most - 1))
    least = max(most // 2, min(overlap + LONG_UNIT, most - 1), 1)
    kind = kinds_of(text)
    level, mark = levels(kind, ends), rolling(hashes)

    def size_of(a: int, end: int) -> int:
        """Tokens of units a..end by themselves: their sum, but for cut words and for runs of blanks that the cut shortens."""
        s, e = int(ends[a - 1]) if a else 0, int(ends[end])
        if inside[end] or (a and inside[a - 1]) or (e - s > 1 and kind[e - 1] & kind[e - 2] & _BLANK):
            return enc.count(text[s:e])
        return int(cum[end + 1] - cum[a])

    out: list[tuple[int, int, int, int]] = []
    a, shared, n, done = 0, 0, len(ends), -1
    while True:
        start = int(ends[a - 1]) if a else 0
        hi = int(np.searchsorted(cum, cum[a] + most, "right")) - 2  # last unit that fits
        if hi >= n - 1:
            size = size_of(a, n - 1)
            if size <= most:
                out.append((start, len(text), size, shared))
                return out
            hi = n - 2
        hi = max(hi, a)
        lo = min(max(int(np.searchsorted(cum, cum[a] + least, "left")) - 1, a), hi)
        end = snap(lo + int(np.argmin(mark[lo : hi + 1])), lo, hi, level, most // 8, cum)
        size = size_of(a, end)
        while size > most and end > a:
            end -= 1
            size = size_of(a, end)
        if end <= done:  # what is shared leaves no room for the next unit: this piece shares nothing
            a, shared = done + 1, 0
            continue
        out.append((start, int(ends[end]), size, shared))
        if end == n - 1:
            return out
        b, done = end + 1, end
        if overlap:
            b = int(np.searchsorted(cum, cum[end + 1] - overlap, "right")) - 1
            # begin at a word, if there is one within a few tokens before
            for c in range(b, max(a, b - LONG_UNIT), -1):
                if level[c - 1] >= WORD:
                    b = c
                    break
        a = min(max(b, a + 1), end + 1)
        shared = int(cum[end + 1] - cum[a])


def _split_rows(vocab: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.string()]
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, source, text, most, overlap in zip(*(b.column(i).to_pylist() for i in range(5))):
                got = split(enc, text, most, overlap)
                rows += [(doc, source, i + 1, len(got), s + 1, e, n, o, text[s:e]) for i, (s, e, n, o) in enumerate(got)]
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def split_oversized(docs: DataFrame, limits: DataFrame, folder: str | None = None) -> DataFrame:
    """Ordered pieces of the texts that exceed their source's limit.

    ``docs``: doc_id, text, source; ``limits``: source, max_tokens, overlap_tokens (null: 0). Result: doc_id, source,
    piece_no, n_pieces, char_start, char_end (code points, from 1), n_tokens, overlap_tokens (those really shared with
    the piece before), text. An overlap of the limit or more can't be: it counts as the limit less one. Texts within the limit, null and empty texts, and texts of sources without a limit (or with one
    below 1) have no pieces. If a source has several limits, the smallest counts.

    Between half of the limit and the limit, the cut is sought at the unit whose rolling hash over the last units is
    smallest (a landmark that depends on the content alone) and moved to the nearest natural boundary; so an edit
    changes the pieces around it, until a landmark is found again. A text that has no more bytes than its limit has
    tokens is passed over without encoding it. No shuffle: texts are split where they are read.
    """
    limit = limits.where("max_tokens >= 1 and source is not null").groupBy("source").agg(F.min(F.struct(F.col("max_tokens").cast("int").alias("m"), F.coalesce("overlap_tokens", F.lit(0)).cast("int").alias("o"))).alias("x")).select("source", "x.m", "x.o")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").join(small(limit), "source").where("octet_length(text) > m").select("doc_id", "source", "text", "m", "o")
    return rows.mapInArrow(_split_rows(vocabulary(docs.sparkSession, folder)), _SCHEMA)
