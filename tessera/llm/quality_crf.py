"""Text quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from features of itself and of the lines around it; in training, a line has
its document's label. Forward-backward marginals, weighted by the lines' lengths, make the document's quality, which a
logistic regression turns into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf, text
from tessera.llm.labelled import held_out, sample


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _set("abcdefghijklmnopqrstuvwxyz") | _UPPER
_LETTER[0x80:] = True
_DIGIT, _SYMBOL, _MARK, _STOP = _set("0123456789"), _set("#*$%&|<>{}[]=_~^\\/@+"), _set(",;:!?\"'()-"), _set(".!?")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
#: Own features of a line; the neighbours' are appended before and after.
N_OWN = 16


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features (lines x ``N_OWN``), each text's first line, and the lines' lengths in words; blank lines are no lines."""
    starts, ends, first = text.spans(data, at, _NEWLINE)
    words, word_ends, _ = text.spans(data, at)
    line = np.searchsorted(starts, words, "right") - 1
    per_line = np.bincount(line, minlength=len(starts)).astype(float)
    full = per_line > 0
    if not full.all():  # lines of white space alone
        first = np.concatenate([[0], np.cumsum(full)])[first]
        starts, ends, per_line = starts[full], ends[full], per_line[full]
        line = np.searchsorted(starts, words, "right") - 1
    n = len(starts)
    if not n:
        return np.zeros((0, N_OWN)), first, per_line
    total = lambda table: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(table[data])]))
    h = text.span_hash(text.LOWER[data], words, word_ends)
    here = h ^ text.mix(line.astype(np.uint64))
    order = np.argsort(here, kind="stable")
    fresh = np.zeros(len(here), bool)
    fresh[order] = np.concatenate([[True], here[order][1:] != here[order][:-1]]) if len(order) else []
    distinct = np.bincount(line[fresh], minlength=n)
    inner = line[1:] == line[:-1]
    again = np.bincount(line[1:][inner & (h[1:] == h[:-1])], minlength=n)
    odd_end = np.bincount(line[~_LETTER[data[word_ends - 1]] & ~_MARK[data[word_ends - 1]] & ~_STOP[data[word_ends - 1]]], minlength=n)
    marked = np.bincount(line[_MARK[data[word_ends - 1]]], minlength=n)
    short = np.bincount(line[word_ends - words <= 1], minlength=n)
    of = np.repeat(np.arange(len(at) - 1), np.diff(first))
    whole = text.span_hash(data, starts, ends) ^ text.mix(of.astype(np.uint64))
    _, which, times = np.unique(whole, return_inverse=True, return_counts=True)
    size = (ends - starts).astype(float)
    letters = np.maximum(total(_LETTER), 1)
    own = np.column_stack([
        np.ones(n), total(_UPPER) / letters, total(_DIGIT) / size, total(_SYMBOL) / size, total(_MARK) / size, total(_LETTER) / size,
        np.log1p(per_line) / 5, size / per_line / 10, distinct / per_line, np.where(per_line > 40, distinct / per_line, 1.0), again / per_line,
        odd_end / per_line, marked / per_line, short / per_line, _STOP[data[ends - 1]], np.minimum(times[which] - 1, 3) / 3,
    ])
    return own, first, per_line


def _around(own: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after in the same text (zeros where there is none)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = ~begins[1:, None]
    before[1:], after[:-1] = own[:-1] * inner, own[1:] * inner
    return np.concatenate([own, before, after], 1)


@dataclass
class Model:
    weights: np.ndarray
    chain: crf.Chain
    document: tuple[np.ndarray, np.ndarray, np.ndarray]

    def marginals(self, own: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.chain.marginals(_around(own, begins) @ self.weights, begins)

    def score(self, columns: np.ndarray) -> np.ndarray:
        """Rounded, so that equal texts have equal scores whatever batch they come in."""
        w, mean, scale = self.document
        return np.round(1 / (1 + np.exp(-np.clip(((columns - mean) / scale * w[:-1]).sum(1) + w[-1], -30, 30))), 9)


def _begins(first: np.ndarray, n: int) -> np.ndarray:
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return begins


def document_columns(marginal: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The length-weighted mean marginal of each text, as log odds, and whether it has lines at all."""
    sums = lambda x: (lambda c: c[first[1:]] - c[first[:-1]])(np.concatenate([[0.0], np.cumsum(x)]))
    weight = sums(length)
    mean = np.where(weight > 0, sums(marginal * length) / np.maximum(weight, 1), 0.5)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(mean / (1 - mean)), weight > 0])


def train(rows: pd.DataFrame, *, rounds: int = 300) -> Model:
    """Fit on ``rows(text, label)``, equal texts once, both classes with equal weight."""
    rows = rows.drop_duplicates("text")
    data, at = text.column(pa.array(rows["text"], pa.large_string()))
    good = rows["label"].to_numpy(np.int64)
    parts = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in text.slices(at)]
    own = np.concatenate([np.zeros((0, N_OWN)), *(p[0] for p in parts)])
    length = np.concatenate([np.zeros(0), *(p[2] for p in parts)])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[1]) for p in parts)]))]).astype(np.int64)
    model = Model(np.zeros(3 * N_OWN), crf.Chain(), (np.array([1.0, 0.0, 0.0]), np.zeros(2), np.ones(2)))
    if not len(own) or len(set(good)) < 2:
        return model
    begins, labels = _begins(first, len(own)), np.repeat(good, np.diff(first))
    x = _around(own, begins)
    per_doc = np.repeat(1 / np.maximum(np.diff(first), 1), np.diff(first))
    class_total = np.bincount(labels, per_doc, 2)
    crf.fit(model.chain, lambda: x @ model.weights, lambda d: [x.T @ d], [model.weights], labels, begins, per_doc / class_total[labels], rounds, 0.1)
    columns = document_columns(model.marginals(own, begins), first, length)
    model.document = crf.logistic(columns, good, 1 / np.bincount(good)[good])
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text.column(batch.column(1))
        for i, j in text.slices(at):
            own, first, length = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            marginal = model.marginals(own, _begins(first, len(own)))
            score = model.score(document_columns(marginal, first, length))
            lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(marginal))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), lines], ["doc_id", "score", "line_scores"])


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, per_class: int = 3000, max_chars: int = 30_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, line_scores`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` teaches the model, held-out rows aside, by at most ``per_class`` rows a class of up to
    ``max_chars`` code points. ``line_scores`` are the marginals of the lines that have a word; predicted is 1 from
    ``threshold`` on. The score depends on the text alone. A null, empty or blank text has no lines and a fixed score;
    repeated rows are each scored; without labels of both classes every score is the same; an empty table gives an empty
    result; further columns are ignored.
    """
    model = train(sample(docs, labels, "quality", per_class=per_class, max_chars=max_chars))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _scored(b, model), "doc_id long, score double, line_scores array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "line_scores")


def good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, per_class: int = 3000, max_chars: int = 30_000) -> DataFrame:
    """The rows of ``docs`` that ``quality`` doesn't reject, with all their columns: scored and filtered where they lie, without a shuffle."""
    model = train(sample(docs, labels, "quality", per_class=per_class, max_chars=max_chars))
    place = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            scored = _scored(iter([pa.RecordBatch.from_arrays([ids, batch.column(place)], ["doc_id", "text"])]), model)
            score = np.concatenate([np.zeros(0), *(np.asarray(b.column(1)) for b in scored)])
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(passing, docs.schema)
