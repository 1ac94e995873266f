"""Piece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and its inverse.

The pieces and scores come from a vocabulary file; the best segmentation is the one with the largest sum of scores. The
automaton reports at every position the pieces that end there (it follows the output links, the longest piece first),
and each relaxes the best score of that position. A character without a piece becomes its UTF-8 bytes, at a fixed
penalty below the lowest score. Spaces are part of the pieces that follow them, and a non-empty text gets one space
before it. No piece has a space after another character, so texts are cut there and every chunk is solved once.
A literal U+2581 is not taken for a space but goes to bytes, so that every text decodes to itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text
from tessera.llm.chunks import PASS_BYTES, ChunkEncoder

#: How far an unknown character's score lies below the lowest normal score.
UNKNOWN_PENALTY = 10.0
_SPACE_MARK = "▁"


class PieceModel:
    """The pieces of a vocabulary file with their scores; scores below -1e8 mark pieces that are a last resort and don't set the penalty."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.out: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        self.automaton = ahocorasick.Automaton()
        lowest, self.known = 0.0, set()
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.out[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surface = piece.replace(_SPACE_MARK, " ")
                if " " in surface.lstrip(" "):
                    raise ValueError(f"piece {piece!r} has a space after another character, so texts can't be cut at spaces")
                self.out[i] = surface.encode()
                score = model.get_score(i)
                self.automaton.add_word(surface, (len(surface), score, i))
                self.known |= {surface} if len(surface) == 1 else set()
                lowest = min(lowest, score) if score > -1e8 else lowest
        self.unknown = lowest - UNKNOWN_PENALTY
        self.automaton.make_automaton()

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of the best segmentation; of two equally good ones, the one with the longer last piece."""
        n = len(chunk)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        done = 0

        def skip(upto: int) -> None:  # over the characters that are no pieces
            nonlocal done
            for p in range(done, upto):
                if chunk[p] not in self.known and best[p] + self.unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + self.unknown, (1, -1)
            done = upto

        for end, (length, score, i) in self.automaton.iter(chunk):
            to = end + 1
            skip(to)
            if best[to - length] + score > best[to]:
                best[to], back[to] = best[to - length] + score, (length, i)
        skip(n)
        ids: list[int] = []
        while n:
            length, i = back[n]
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(chunk[n - 1].encode())]
            n -= length
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space put before it."""
        return b"".join(map(self.out.__getitem__, ids))[1:].decode()


@cache
def _model(path: str) -> tuple[PieceModel, ChunkEncoder]:
    model = PieceModel(path)
    return model, ChunkEncoder(lambda chunks: [model.encode_chunk(c.decode()) for c in chunks])


def space_chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before every non-empty text, and its chunks: runs of spaces with what follows up to the next."""
    full = at[1:] > at[:-1]
    data = np.insert(data, at[:-1][full], 0x20)
    at = at + np.concatenate([[0], np.cumsum(full)])
    space = data == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[at[:-1][full]] = True
    starts = np.flatnonzero(head)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, at)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, encoder = _model(path)
    for batch in batches:
        data, at = text.column(batch.column(1))
        for i, j in text.slices(at, PASS_BYTES):
            part, starts, ends, first = space_chunks(data[at[i] : at[j]], at[i : j + 1] - at[i])
            ids, total = encoder(part, starts, ends)
            lists = pa.ListArray.from_arrays(pa.array(total[first].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``.

    A null or empty text has no ids; texts of any length are encoded whole; repeated rows and rows without an id are each
    encoded; of equally good segmentations the one with the longer last piece counts; further columns are ignored; an empty
    table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _encoded(b, model), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    out = _model(path)[0].out
    size = np.array([len(b) for b in out], np.int64)
    start, blob = np.cumsum(size) - size, np.frombuffer(b"".join(out), np.uint8)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            at = np.asarray(part.column(1).offsets).astype(np.int64)
            ids = np.asarray(part.column(1).values)[at[0] : at[-1]]
            at = at - at[0]
            before = np.concatenate([[0], np.cumsum(size[ids])])
            surface = blob[np.repeat(start[ids] - before[:-1], size[ids]) + np.arange(before[-1])].tobytes()
            raw, bounds = ids.astype("<u4").tobytes(), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            texts = [surface[before[s] + 1 : before[e]].decode() for s, e in bounds]  # without the space put before it
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in bounds]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text`` of every row of ``encoded(doc_id, ids)``.

    Null or no ids give the empty text; repeated rows are each decoded; further columns are ignored; ids that aren't in the
    vocabulary, or don't make UTF-8, are an error; an empty table gives an empty result.
    """
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, model), "doc_id long, n_ids long, ids_crc32 long, text string")
