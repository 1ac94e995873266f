"""Toxic spans by a linear-chain conditional random field over a text's words.

Token labels come from labelled documents: a word is toxic where it stands in a toxic document and one of its features
(the word, or its first 4, 5 or 6 bytes) is surely more common in toxic documents than in clean ones: the log ratio of its
document frequencies stays above a bound even when two standard errors are taken off. The field learns them
from hashed features of the word and its neighbours. Over a whole text, forward-backward marginals give the spans (runs
of words that are more likely toxic than not) and aggregate to the document's score by a logistic regression.
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
from tessera.llm.labelled import held_out, sample, without_copies

BITS = 18
#: Bytes of the prefixes that are features, besides the whole word.
PREFIXES = (4, 5, 6)
#: The weight table holds three parts: features of the word itself, of the one before, of the one after.
_OWN, _PART = 1 + len(PREFIXES), 1 << BITS
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends without final punctuation, each text's first word, and the words' own features (words x ``_OWN``)."""
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at)
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & _EDGE[data[ends - 1]])
    starts = starts + ((ends - starts > 1) & _EDGE[data[starts]]) if len(starts) else starts
    own = np.empty((len(starts), _OWN), np.int32)
    for f, most in enumerate((None, *PREFIXES)):
        h = text.span_hash(data, starts, ends if most is None else np.minimum(ends, starts + most))
        own[:, f] = (text.mix(h + np.uint64(f + 1)) >> np.uint64(64 - BITS)).astype(np.int32)
    return starts, ends, first, own


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    chain: crf.Chain
    document: tuple[np.ndarray, np.ndarray, np.ndarray]

    def emission(self, own: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Scores of label 1: the word's features, and the whole-word features of its neighbours in the same text."""
        out = self.bias[0] + self.weights[:_PART][own].sum(1)
        before, after = self.weights[_PART : 2 * _PART][own[:-1, 0]], self.weights[2 * _PART :][own[1:, 0]]
        inner = ~begins[1:]
        out[1:] += before * inner
        out[:-1] += after * inner
        return out

    def document_columns(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the score sees of each text: the expected number of toxic words, the largest marginal, and their share."""
        total = np.concatenate([[0.0], np.cumsum(marginal)])
        summed, n = total[first[1:]] - total[first[:-1]], np.diff(first)
        top = np.array([marginal[s:e].max() if e > s else 0.0 for s, e in zip(first[:-1], first[1:], strict=True)])
        return np.column_stack([np.log1p(summed), top, np.sqrt(summed / np.maximum(n, 1))])

    def score(self, columns: np.ndarray) -> np.ndarray:
        """Rounded, so that equal texts have equal scores whatever batch they come in."""
        w, mean, scale = self.document
        return np.round(1 / (1 + np.exp(-np.clip(((columns - mean) / scale * w[:-1]).sum(1) + w[-1], -30, 30))), 9)


def _begins(first: np.ndarray, n: int) -> np.ndarray:
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return begins


def _seeds(own: np.ndarray, first: np.ndarray, toxic: np.ndarray, bound: float) -> np.ndarray:
    """Token labels from document labels, by document frequencies of the words' features."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    seeds = np.zeros(len(own), bool)
    for f in range(own.shape[1]):
        pairs = np.unique(doc * np.int64(_PART) + own[:, f])
        in_doc, feature = pairs // _PART, pairs % _PART
        bad = np.bincount(feature[toxic[in_doc] == 1], minlength=_PART)
        good = np.bincount(feature[toxic[in_doc] == 0], minlength=_PART)
        odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
        error = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        seeds |= (odds - 2 * error >= bound)[own[:, f]]
    return (seeds & (toxic[doc] == 1)).astype(np.int64)


def train(rows: pd.DataFrame, *, rounds: int = 25, bound: float = 1.2) -> Model:
    """Fit on ``rows(text, label)``, copies once; a feature whose log ratio is surely over ``bound`` is toxic.

    The field learns from three rows of four, and the document score from the rest, on which the field can err.
    """
    rows = without_copies(rows)
    data, at = text.column(pa.array(rows["text"], pa.large_string()))
    toxic = rows["label"].to_numpy(np.int64)
    model = Model(np.zeros(3 * _PART), np.array([-4.0]), crf.Chain(), (np.array([0.0, 0.0, 0.0, -2.0]), np.zeros(3), np.ones(3)))
    if len(set(toxic)) < 2:
        return model
    parts = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in text.slices(at)]
    own = np.concatenate([p[3] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]).astype(np.int64)
    # Of each class, every fourth row.
    rank = np.zeros(len(toxic), np.int64)
    for value in (0, 1):
        rank[toxic == value] = np.arange((toxic == value).sum())
    rest = rank % 4 == 3
    _fit_field(model, *_rows_of(own, first, ~rest), toxic[~rest], rounds, bound)
    own, first = _rows_of(own, first, rest) if len(set(toxic[rest])) == 2 else (own, first)
    toxic = toxic[rest] if len(set(toxic[rest])) == 2 else toxic
    begins = _begins(first, len(own))
    columns = model.document_columns(model.chain.marginals(model.emission(own, begins), begins), first)
    model.document = crf.logistic(columns, toxic, np.ones(len(toxic)))
    model.weights = model.weights.astype(np.float32)
    return model


def _rows_of(own: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some of the texts, and each one's first word."""
    n = np.diff(first)
    return own[np.repeat(rows, n)], np.concatenate([[0], np.cumsum(n[rows])])


def _fit_field(model: Model, own: np.ndarray, first: np.ndarray, toxic: np.ndarray, rounds: int, bound: float) -> None:
    begins, labels = _begins(first, len(own)), _seeds(own, first, toxic, bound)
    inner = ~begins[1:]
    balance = np.where(labels == 1, max(1.0, 0.2 * len(labels) / max(labels.sum(), 1)), 1.0)

    def gradient(d: np.ndarray) -> list[np.ndarray]:
        g = np.zeros(3 * _PART)
        for f in range(_OWN):
            g[:_PART] += np.bincount(own[:, f], d, _PART)
        g[_PART : 2 * _PART] = np.bincount(own[:-1, 0], d[1:] * inner, _PART)
        g[2 * _PART :] = np.bincount(own[1:, 0], d[:-1] * inner, _PART)
        return [g + model.weights / balance.sum(), np.array([d.sum()])]  # with a Gaussian prior

    if len(own):
        crf.fit(model.chain, lambda: model.emission(own, begins), gradient, [model.weights, model.bias], labels, begins, balance, rounds, 0.3)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        data, at = text.column(batch.column(1))
        for i, j in text.slices(at):
            part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends, first, own = features(part, bounds)
            begins = _begins(first, len(own))
            marginal = model.chain.marginals(model.emission(own, begins), begins)
            score = model.score(model.document_columns(marginal, first))
            hot = marginal >= 0.5
            opens = np.flatnonzero(hot & ~(np.append(False, hot[:-1]) & ~begins))
            closes = np.flatnonzero(hot & ~(np.append(hot[1:], False) & ~np.append(begins[1:], True)))
            # Offsets are in code points: bytes that don't continue a character, before the place.
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            of = np.searchsorted(first, opens, "right") - 1
            from_, to = points[starts[opens]] - points[bounds[of]], points[ends[closes]] - points[bounds[of]]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, first).astype(np.int32)), pa.StructArray.from_arrays([pa.array(from_.astype(np.int32)), pa.array(to.astype(np.int32))], fields=list(span)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), lists], ["doc_id", "score", "spans"])


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, per_class: int = 1000, max_chars: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teaches the model, held-out rows aside, by at most ``per_class`` rows a class of up to
    ``max_chars`` code points. ``spans`` are the toxic runs' offsets in code points; predicted is 1 from ``threshold`` on.
    The score depends on the text alone. A null, empty or blank text has no spans and the score of a text without toxic
    words; repeated rows are each scored; without labels of both classes every score is the same; an empty table gives
    an empty result; further columns are ignored.
    """
    model = train(sample(docs, labels, "toxic", per_class=per_class, max_chars=max_chars))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _scored(b, model), "doc_id long, score double, spans array<struct<start int, end int>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def not_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, per_class: int = 1000, max_chars: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` doesn't reject, with all their columns: scored and filtered where they lie, without a shuffle."""
    model = train(sample(docs, labels, "toxic", per_class=per_class, max_chars=max_chars))
    place = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(range(batch.num_rows), pa.int64())
            scored = _scored(iter([pa.RecordBatch.from_arrays([ids, batch.column(place)], ["doc_id", "text"])]), model)
            score = np.concatenate([np.zeros(0), *(np.asarray(b.column(1)) for b in scored)])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(passing, docs.schema)
