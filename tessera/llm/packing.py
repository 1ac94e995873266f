"""Vector best-fit packing of tokenized documents into training sequences.

Documents become pieces of at most ``max_tokens`` ids (only longer ones are cut). Pieces are dealt by hash to groups of
about ``group_sequences`` sequences, whose number follows the total of ids; each group is packed on its own, so memory
is bounded and the loss is a fraction of one sequence a group. In a group, pieces go in order of falling size, each to
the open sequence that has room in every dimension (tokens, documents, attention cost) and that fits best: by the
weighted dot product of the piece with the residual capacities, or by the smallest weighted norm of the residual left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text
from tessera.llm.chunks import PASS_BYTES, ChunkEncoder
from tessera.llm.scratch import materialize

#: A character that the vocabulary has as one id; chunks are encoded many at a time between such marks.
_MARK = "★"


@cache
def _encoder(path: str) -> ChunkEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    (mark,) = ids([_MARK])[0]

    def encode(chunks: list[bytes]) -> list[list[int]]:
        words = [c.decode() for c in chunks]
        plain = [i for i, w in enumerate(words) if _MARK not in w and "<|" not in w]
        out: list[list[int]] = [[] for _ in words]
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            joined = np.array(ids([f" {_MARK} ".join(words[i] for i in part)])[0], np.int32)
            for i, x in zip(part, np.split(joined, np.flatnonzero(joined == mark)), strict=True):
                out[i] = x[x != mark].tolist()
        odd = [i for i, w in enumerate(words) if _MARK in w or "<|" in w]
        for i, x in zip(odd, ids([words[i] for i in odd]) if odd else [], strict=True):
            out[i] = x
        return out

    return ChunkEncoder(encode)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def word_chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, chunk starts and ends and each text's first chunk, for a lower-casing word tokenizer that drops white space.

    A chunk is a word; a single full stop or comma after a final ASCII letter is a chunk of its own, as it is a piece of
    its own to the tokenizer. A-Z is lowered first unless a special token's opening occurs.
    """
    if len(data) > 1 and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
        data = text.LOWER[data]
    starts, ends, first = text.spans(data, at)
    tail = np.zeros(len(starts), bool)
    long = ends - starts > 1
    end = ends[long]
    tail[long] = ((data[end - 1] == 0x2C) | (data[end - 1] == 0x2E)) & _LETTER[data[end - 2]]
    place = np.repeat(np.arange(len(starts)), 1 + tail)
    second = np.concatenate([[False], place[1:] == place[:-1]]) if len(place) else np.zeros(0, bool)
    all_ends = ends[place] - (tail[place] & ~second)
    before = np.concatenate([[0], np.cumsum(1 + tail)])
    return data, np.where(second, ends[place] - 1, starts[place]), all_ends, before[first]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        data, at = text.column(batch.column(1))
        doc_ids = batch.column(0)
        for i, j in text.slices(at, PASS_BYTES):
            part, starts, ends, first = word_chunks(data[at[i] : at[j]], at[i : j + 1] - at[i])
            ids, total = encoder(part, starts, ends)
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            bounds = total[first].tolist()
            for d in range(j - i):
                own = np.append(ids[bounds[d] : bounds[d + 1]], end_id).astype("<u4")
                for p, s in enumerate(range(0, len(own), most)):
                    cut = own[s : s + most]
                    row.append(i + d)
                    piece.append(p)
                    start.append(s)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if keep_ids:
                        kept.append(cut.astype(np.int32))
            out = [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names + ["ids"] * keep_ids)


def tokenized(docs: DataFrame, tokenizer: str, *, max_tokens: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``: every text's ids and ``end_id``, cut to pieces.

    A null or empty text is its end id alone; texts of any length are taken whole; repeated rows and rows without an id are
    each tokenized; further columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _pieces(b, tokenizer, max_tokens, end_id, keep_ids), schema)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and order of placement of every row of ``sizes`` (items x dimensions); no item may exceed ``capacity``.

    rule "dot": the bin whose residual has the largest weighted dot product with the item; "norm": the bin whose residual
    after the item has the smallest weighted norm. Ties go to the bin opened first.
    """
    scaled = sizes / capacity
    order = np.lexsort((np.arange(len(sizes)), -(scaled * weights).sum(1)))
    dims = range(len(capacity))
    least = sizes.min(0) if len(sizes) else capacity
    room = np.zeros((len(capacity), len(sizes)))  # the open bins' residuals, a row for each dimension
    name, live, n = np.zeros(len(sizes), np.int64), 0, 0
    bins = np.zeros(len(sizes), np.int64)
    for count, i in enumerate(order.tolist()):
        size = sizes[i]
        score = np.zeros(live)
        for d in dims:
            if weights[d] and rule == "dot":
                score -= room[d, :live] * (scaled[i, d] * weights[d] / capacity[d])
            elif weights[d]:
                score += (room[d, :live] - size[d]) ** 2 * (weights[d] / capacity[d] ** 2)
        for d in dims:
            score[room[d, :live] < size[d]] = np.inf
        to = int(np.argmin(score)) if live else 0
        if not live or score[to] == np.inf:
            bins[i], n = n, n + 1
            if (capacity - size >= least).all():
                room[:, live], name[live], live = capacity - size, bins[i], live + 1
            continue
        bins[i] = name[to]
        room[:, to] -= size
        if count % 64 == 63:  # bins without room for the smallest item are closed
            keep = np.flatnonzero((room[:, :live] >= least[:, None]).all(0))
            room[:, : len(keep)], name[: len(keep)], live = room[:, keep], name[keep], len(keep)
    return bins, order


_SEQUENCE = "sequence_id long, ids array<int>, doc_ids array<long>, pieces array<int>, starts array<long>, ends array<long>"


def _placed(pieces: pa.Table, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every row. Ids stay in Arrow columns, so nulls among them don't turn them into doubles."""
    order = pc.sort_indices(pieces.select(["length", "doc_id", "piece"]), [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).to_numpy()
    length = pieces.column("length").to_numpy().astype(np.int64)[order]
    sizes = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], 1)
    if (sizes > capacity).any():
        raise ValueError("a piece exceeds a sequence's capacity by itself")
    bins, turn = best_fit(sizes, capacity, weights, rule)
    at = turn[np.argsort(bins[turn], kind="stable")]  # by bin, then by turn of placement
    before = np.cumsum(length[at]) - length[at]
    first = np.flatnonzero(np.diff(bins[at], prepend=-1))
    offset = np.empty(len(at), np.int64)
    offset[order[at]] = before - np.repeat(before[first], np.diff(np.append(first, len(at))))
    found = np.empty(len(at), np.int64)
    found[order] = bins
    return found, offset


def _joined(pieces: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """A row for each sequence: its ids, and which piece's ids end where in it."""
    rows = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[rows], offset[rows], pieces.column("length").to_numpy()[rows]
    first = np.flatnonzero(np.diff(sequence, prepend=-1))
    bounds = pa.array(np.append(first, len(rows)).astype(np.int32))
    taken = lambda name: pieces.column(name).combine_chunks().take(pa.array(rows))
    listed = lambda values: pa.ListArray.from_arrays(bounds, values)
    before = np.concatenate([[0], np.cumsum(length)])[[*first, len(rows)]]
    ids = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), taken("ids").flatten())
    columns = [pa.array(sequence[first]), ids, *(listed(x) for x in (taken("doc_id"), taken("piece"), taken("start"), pa.array(offset + length)))]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SEQUENCE.split(", ")])


def pack(
    pieces: DataFrame,
    *,
    max_tokens: int = 2048,
    max_documents: int | None = None,
    times_mean: float | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.3, 0.3),
    rule: str = "dot",
    group_sequences: int = 2048,
    read: tuple[Callable[[pa.RecordBatch], pa.Table], str] | None = None,
) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with ``sequence_id, offset`` added.

    A sequence holds at most ``max_tokens`` ids, ``max_documents`` pieces and an attention cost (the sum of the squared
    lengths) of ``max_attention``; None sets a bound that the tokens imply anyway. ``times_mean`` bounds the pieces by a
    multiple of their mean number in full sequences instead, whatever the lengths are; it opens at most 1 / ``times_mean`` of
    the sequences more. Every piece is placed, none is cut; a
    piece beyond a capacity by itself is an error. Repeated rows are packed each; a null doc_id is a doc_id like others;
    an empty table gives an empty result; columns other than the two added pass through, and columns with their names are
    replaced. ``read``,
    a function and its schema, gets each group's pieces with ids as rows like those of ``sequences`` and gives the result.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    row = pieces.agg(F.sum("length").alias("total"), F.count("*").alias("n")).first()
    total, n = row["total"] or 0, row["n"]
    groups = max(1, round(total / (max_tokens * group_sequences)))
    if times_mean:
        max_documents = min(max_documents or max_tokens, math.ceil(times_mean * max(1.0, n * max_tokens / max(total, 1))))
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens**2], float)
    name = "group"
    while name in pieces.columns:
        name += "_"

    def packed(table: pa.Table) -> pa.Table:
        found, offset = _placed(table, capacity, np.array(weights), rule)
        sequence = (table.column(name)[0].as_py() << 32) + found
        table = table.drop_columns([name])
        return read[0](_joined(table, sequence, offset)) if read else table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # The row's place keeps rows that repeat an id from all going to one group; the pieces were written, so it is fixed.
    group = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.withColumn(name, group).groupBy(name).applyInArrow(packed, read[1] if read else f"{fields}, sequence_id long, offset long")


def _packed_ids(docs: DataFrame, tokenizer: str, read: Callable[[pa.RecordBatch], pa.Table], schema: str, bounds: dict) -> DataFrame:
    pieces = tokenized(docs, tokenizer, max_tokens=bounds.get("max_tokens", 2048), keep_ids=True).drop("ids_crc32")
    return pack(pieces, read=(read, schema), **bounds)


def sequences(docs: DataFrame, tokenizer: str, **bounds) -> DataFrame:
    """``sequence_id, ids, doc_ids, pieces, starts, ends``: the packed training sequences of ``docs(doc_id, text)``.

    Of the pieces in a row, ``ends`` tells where each ends in ``ids``, and ``starts`` where it begins in its document.
    Nulls, empty and long texts, repeated rows and empty tables are as in ``packed_documents``.
    """
    return _packed_ids(docs, tokenizer, lambda packed: pa.Table.from_batches([packed]), _SEQUENCE, bounds)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _unpacked(packed: pa.RecordBatch, keep_ids: bool) -> pa.Table:
    """The pieces of sequences: lengths, offsets, checksums and ids are taken from the sequences' own ids."""
    at, ids = np.asarray(packed.column(1).offsets).astype(np.int64), np.asarray(packed.column(1).values)
    doc_id, piece, start, end = (packed.column(c).flatten() for c in range(2, 6))
    row = np.repeat(np.arange(len(packed)), np.asarray(packed.column(5).value_lengths()))
    end = np.asarray(end)
    offset = np.where(np.diff(row, prepend=-1) > 0, 0, np.concatenate([[0], end[:-1]]))
    s, e = at[row] + offset, at[row] + end
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
    out = [doc_id, piece, start, pa.array(end - offset), pa.array(crc, pa.int64()), packed.column(0).take(pa.array(row)), pa.array(offset)]
    if keep_ids:
        out.append(pa.ListArray.from_arrays(pa.array(np.append(s, len(ids)).astype(np.int32)), pa.array(ids)))
    return pa.Table.from_arrays(out, [f.split()[0] for f in _PLACED.split(", ")] + ["ids"] * keep_ids)


def packed_documents(docs: DataFrame, tokenizer: str, *, keep_ids: bool = False, **bounds) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, on request, ``ids`` of every piece of ``docs(doc_id, text)``.

    All of it is read back from the packed sequences. A null or empty text is one piece, its end id alone. Rows that
    repeat an id are packed each, and so are rows without one; further columns are ignored; an empty table gives an empty
    result. ``bounds`` are those of ``pack``.
    """
    schema = _PLACED + ", ids array<int>" * keep_ids
    return _packed_ids(docs, tokenizer, lambda packed: _unpacked(packed, keep_ids), schema, bounds)
