"""Operator 8: language identification with averaged hashed subword embeddings.

Features are the letter n-grams (1 to 4 code points, a space on either side at
most) of the lower-cased text, hashed into buckets.  A document's vector is the
mean of its buckets' embeddings; a linear softmax gives the language.  Both are
trained together by stochastic gradient descent in numpy on the driver, on
whole texts and on random runs of their words (so short texts are known too),
from at most ``PER_LANGUAGE`` documents of each language.  A part of them is kept
out of training to fit the temperature and the score under which a prediction
is rejected (by whole texts).  Prediction covers whole texts: because mean and softmax layer are
linear, the layer is applied to the embeddings once, and a text's logits are the
mean of its buckets' rows.

Defined results: null text and text without letters give ``und``, score 0 and
rejection, as does a model without any labelled row; rows are judged one by one,
so repeated rows get repeated results; ties between languages go to the first in
order of name; rows with null id are judged, and never learnt from; extra
columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, give_back, slices, texts_of

BUCKETS, DIM, LONGEST = 1 << 16, 16, 4
#: Documents of each language that the model learns from, at most (a fixed, hashed choice).
PER_LANGUAGE = 1500
EPOCHS, RATE, SEED = 6, 0.5, 7
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
_FACTOR = np.uint32(0x9E3779B1)
_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _IS_LETTER[0]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with everything but letters as 0, and a 0 at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[c], c, np.uint32(0))


def ngrams(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: where n-grams start, and their buckets."""
    h = c * _FACTOR
    some = c != 0
    at = np.flatnonzero(some)
    yield at, h[at] >> np.uint32(16)
    inner = np.ones(len(c) - 1, dtype=bool)  # whether all between the first and the last are letters
    for n in range(2, min(LONGEST, len(c)) + 1):
        h = (h[:-1] ^ c[n - 1 :]) * _FACTOR + np.uint32(n)
        if n > 2:
            inner = inner[:-1] & some[n - 2 : len(c) - 1]
        at = np.flatnonzero(inner if n > 2 else some[:-1] | some[1:])
        yield at, (h[at] ^ (h[at] >> np.uint32(15))) >> np.uint32(16)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    got = [b for _, b in ngrams(code_points(text))]
    ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint32), return_counts=True)
    return ids.astype(np.int32), n.astype(np.int32)


@dataclass(frozen=True)
class Model:
    """langs, the logits of each bucket, the bias, the temperature and the least score that is accepted."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Mean logits of whole texts, all at once."""
        points = [code_points(t or "") for t in texts]
        ends = np.cumsum([len(p) for p in points])
        starts = ends - [len(p) for p in points]
        c = np.concatenate(points)
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for at, buckets in ngrams(c):
            # No n-gram reaches from one text into the next: two 0s in a row end all.
            owner, cut = np.searchsorted(at, starts), np.searchsorted(at, ends)
            some = np.flatnonzero(cut > owner)
            if len(some):
                sums[some] += np.add.reduceat(self.table[buckets], owner[some], axis=0, dtype=np.float64)
            n += cut - owner
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return best, z[np.arange(len(z)), best]


def pieces(text: str, rng: np.random.Generator) -> list[str]:
    """The text and three random runs of its words."""
    words = text.split()
    out = [text]
    for most in (4, 12, 40):
        n = int(rng.integers(1, most + 1))
        if len(words) > n:
            k = int(rng.integers(0, len(words) - n + 1))
            out.append(" ".join(words[k : k + n]))
    return out


def train(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, lang) rows, of which a fifth only calibrates."""
    rows = [(t, lang) for t, lang in rows if t and LETTER.search(t)]
    langs = tuple(sorted({lang for _, lang in rows}))
    rng = np.random.default_rng(SEED)
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    data = [(*bucket_counts(p), langs.index(lang), k) for k, (t, lang) in enumerate(rows) for p in pieces(t, rng)]
    data = [d for d in data if len(d[0])]
    held = rng.random(len(rows)) < 0.2 if len(rows) >= 20 else np.zeros(len(rows), dtype=bool)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    learn = [d for d in data if not held[d[3]]]
    steps = EPOCHS * len(learn)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            ids, n, lang, _ = learn[i]
            share = n / n.sum()
            rate = RATE * (1 - step / steps) + 1e-3
            step += 1
            e = embed[ids]
            mean = share @ e
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # the mean's gradient, scaled up by the number of buckets that share it
            embed[ids] = e - (rate * min(len(ids), 50)) * share[:, None] * back
    model = Model(langs, (embed @ layer).astype(np.float32), bias)
    whole = {k: d for d in reversed(data) for k in [d[3]] if held[k]}  # the first of each row's pieces is its whole text
    return calibrated(model, list(whole.values()))


def calibrated(model: Model, data: list, error: float = 0.01, floor: float = 0.5) -> Model:
    """Fit the temperature by likelihood, and the least score so that at most ``error`` of what is accepted is wrong."""
    if not data:
        return model
    logits = np.array([(n / n.sum()) @ model.table[ids] + model.bias for ids, n, _, _ in data])
    truth = np.array([d[2] for d in data])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    t = min((2.0 ** (k / 4) for k in range(-24, 25)), key=loss)
    model = Model(model.langs, model.table, model.bias, t)
    best, score = model.scores(logits)
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[order] != truth[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= error)
    least = float(score[order[fine[-1]]]) if len(fine) else 1.0
    return Model(model.langs, model.table, model.bias, t, min(max(floor, least), 0.9))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(df: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of (doc_id, text, lang) that aren't held out."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return train([])
    # a hashed share of each language: its expected size is per_language at most
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])
    model = train([(r["text"], r["lang"]) for r in sorted(chosen.collect(), key=lambda r: (r["doc_id"], r["lang"], r["text"]))])
    give_back()
    return model


def _identified(rows: DataFrame, model: Model, more: str = "") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of as many numbers as there are languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, most=1 << 20):
            texts = b.column(1).to_pylist()
            known = np.array([bool(t and LETTER.search(t)) for t in texts]) & bool(m.langs)
            pred, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            if known.any():
                best, s = m.scores(m.logits([t for t, k in zip(texts, known, strict=True) if k]))
                pred[known], score[known] = np.array(m.langs, dtype=object)[best], s
            cols = [pa.array(pred, pa.string()), pa.array(score), pa.array(known & (score >= m.least))]
            keep = range(b.num_columns) if more else (0,)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], [*(b.schema.names[k] for k in keep), "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, "doc_id long" + more + ", lang_pred string, score double, accepted boolean")


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row."""
    return _identified(texts_of(df, id_col, text_col), model)


def accepted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table whose language is told with enough confidence, with its columns."""
    rows, restore, more = carried(df, id_col, text_col)
    return _identified(rows, model, ", text string" + more).where("accepted").select(*restore)
