"""Encoding of a whole corpus with a public tokenizer, long texts in overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubscope.llm.encoder import PRE_TOKEN, Encoder, encoder, vocabulary
from pubscope.session import cut, small

#: Texts of more characters than this are encoded in chunks, by several tasks.
CHUNK = 16_384
#: Characters that a chunk shares with the next one.
OVERLAP = 1_024

_PART = "key string, id long, no int, ids array<int>, begin_at array<int>, begin_n array<int>, end_at array<int>, end_n array<int>"


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode_short(vocab: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            for at in range(0, b.num_rows, 2000):  # a batch of output stays at a few MB
                part = b.slice(at, 2000)
                rows = [enc.ids(t) if t else np.empty(0, np.uint32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(rows)], names=["id", "ids"])

    return run


def encode_chunk(enc: Encoder, chunk: str, first: bool, last: bool, overlap: int) -> tuple[np.ndarray, list[int], list[int], list[int], list[int]]:
    """Ids of a chunk, and its pre-token boundaries in the zones shared with its neighbours.

    The boundaries come as offsets in the chunk and as the number of ids before them, for the head zone and the tail
    zone. A boundary at the chunk's very end depends on what follows and is not listed, except in the last chunk.
    """
    words = PRE_TOKEN.findall(chunk)
    begins = np.cumsum([0, *map(len, words)])[:-1]
    ids = enc.ids(chunk).astype(np.int32)

    def zone(a: int, b: int, base: int, n: int) -> tuple[list[int], list[int]]:
        """Offsets from ``base`` of words a..b, and the ids before each, the first one having ``n`` before it."""
        before = np.cumsum([n, *(len(enc.piece(w)) for w in words[a:b])])[:-1] if b > a else []
        return (begins[a:b] - base).tolist(), np.asarray(before, int).tolist()

    head = ([], []) if first else zone(0, int(np.searchsorted(begins, overlap)), 0, 0)
    tail_from = len(chunk) - overlap
    k = int(np.searchsorted(begins, tail_from))
    tail = ([], []) if last else zone(k, len(words), tail_from, len(ids) - sum(len(enc.piece(w)) for w in words[k:]))
    return ids, *head, *tail


def _encode_chunks(vocab: Broadcast, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        names = ["key", "id", "no", "ids", "begin_at", "begin_n", "end_at", "end_n"]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [encode_chunk(enc, t, n == 0, n == last, overlap) for t, n, last in zip(*(part.column(i).to_pylist() for i in (4, 2, 3)))]
                lists = [list_array([np.asarray(o[i], np.int32) for o in out]) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists], names=names)

    return run


def stitch(parts: list[tuple]) -> list[np.ndarray] | None:
    """The ids of a text from its chunks (ids, head_at, head_n, tail_at, tail_n), in order.

    Two neighbours are joined at the first boundary that both know: from there on both read the same pre-tokens. None
    if two of them share no boundary, which takes a pre-token longer than the overlap.
    """
    out, begin = [], 0
    for i, (ids, _, _, tail_at, tail_n) in enumerate(parts):
        if i + 1 == len(parts):
            out.append(ids[begin:])
            break
        common, x, y = np.intersect1d(tail_at, parts[i + 1][1], return_indices=True)
        # the cut may not lie before where this chunk itself takes over
        ok = np.flatnonzero(np.asarray(tail_n)[x] >= begin) if len(common) else []
        if not len(ok):
            return None
        out.append(ids[begin : tail_n[x[ok[0]]]])
        begin = parts[i + 1][2][y[ok[0]]]
    return out


def _stitch_group(t: pa.Table) -> pa.Table:
    """One text's ids, as often as the text is there: equal rows bring every chunk as often as they are repeated."""
    t = t.sort_by("no")
    no = t.column("no").to_numpy()
    times = int((no == 0).sum())
    t = t.take(pa.array(np.unique(no, return_index=True)[1]))
    parts = list(zip(t.column("ids").to_pylist(), *(t.column(c).to_pylist() for c in ("begin_at", "begin_n", "end_at", "end_n"))))
    got = stitch([(np.array(p[0], np.int32), *p[1:]) for p in parts])
    row = np.concatenate(got) if got is not None else None
    ids = pa.array([row.tolist() if row is not None else None], pa.list_(pa.int32()))
    one = pa.table({"key": t.column("key").slice(0, 1), "id": t.column("id").slice(0, 1), "ids": ids})
    return one.take(pa.array([0] * times))


def _decode(vocab: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab).bpe
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = [None if ids is None else b"".join(map(bpe.decode_single_token_bytes, ids)).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, folder: str | None = None) -> DataFrame:
    """The texts of token ids: doc_id, text; null ids give null, no ids the empty text."""
    rows = encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decode(vocabulary(encoded.sparkSession, folder)), "id long, text string").select(F.col("id").alias(id_col), "text")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row's token ids: doc_id, ids (array<int>), without special tokens.

    Null and empty texts have the empty list; blank ones have the ids of their blanks. Repeated ids come as often as
    they are in the table; other columns are ignored. Strings that look like special tokens are ordinary text.

    A text of at most ``chunk`` characters is encoded where it is read, with no shuffle. Longer ones become overlapping
    chunks, which are spread over the cluster, pre-tokenised and encoded in parallel, and joined where their pre-token
    boundaries meet again; one that never meets (a pre-token longer than ``overlap``) is encoded as a whole.
    A text is known by its id and a digest, so a stage that is run again finds the same keys. Decoding is the
    concatenation of the ids' bytes.
    """
    if overlap * 2 >= chunk:
        raise ValueError("chunks must be longer than twice the overlap")
    vocab = vocabulary(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    short = rows.where(f"text is null or length(text) <= {chunk}").mapInArrow(_encode_short(vocab), "id long, ids array<int>")
    step = chunk - overlap
    long = rows.where(f"length(text) > {chunk}").withColumn("key", F.md5("text"))
    last = F.ceil((F.length("text") - chunk) / F.lit(step)).cast("int")
    chunks = (
        long.select("key", "id", "text", last.alias("last"))
        .select("key", "id", "last", "text", F.explode(F.sequence(F.lit(0), "last")).alias("no"))
        .select("key", "id", "no", "last", F.substr("text", F.col("no") * step + 1, F.lit(chunk)).alias("part"))
        .repartition("id", "key", "no")
        .mapInArrow(_encode_chunks(vocab, overlap), _PART)
    )
    joined = cut(chunks.groupBy("id", "key").applyInArrow(_stitch_group, "key string, id long, ids array<int>"), "stitched")
    apart = small(joined.where("ids is null").select("key").distinct())
    whole = long.join(apart, "key", "left_semi").select("id", "text").mapInArrow(_encode_short(vocab), "id long, ids array<int>")
    out = short.unionByName(joined.where("ids is not null").select("id", "ids")).unionByName(whole)
    return out.select(F.col("id").alias(id_col), "ids")
