"""Language identification by error-correcting output codes.

Labels get codewords; a binary logistic classifier on hashed byte n-grams
predicts each bit; loss-weighted decoding chooses the label whose codeword costs
least over all bits and flags a text as ambiguous when the best label's share is
low.

Training takes a bounded sample: about ``PER_LABEL`` rows of each label, chosen
by a hash of the id, featurised on the executors over whole texts.  Only these
sparse vectors reach the driver, where at most ``MOST_LABELS`` labels fit.

Defined results: a null text or one without a letter is ``und`` with score 0; a
null label is never learnt, nor is a row without an id; without any labelled row
every text is ``und``; one label alone is always predicted; of labels that cost
alike the first by name is predicted; repeated rows get equal predictions; an
empty table gives none; columns besides key, text and label are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import prepare, rows_in_slices

#: The bound of the training sample: rows of each label, on average.
PER_LABEL = 400
DIMENSIONS = 4096
GRAMS = (2, 3, 4)
STEPS, RATE, PENALTY = 150, 8.0, 1e-4
#: Labels share one probability; below this the text is flagged.
AMBIGUOUS = 0.5
#: Codewords: up to so many labels every split of the labels is a bit; more get random codewords far apart.
EXHAUSTIVE = 6
#: Labels of one model, at most; the sample's vectors take 16 KB a row on the driver.
MOST_LABELS = 200
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Hashed places of all byte n-grams of the whole text; anything but letters is a space."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint32)
    places = []
    for n in GRAMS:
        if len(raw) >= n:
            h = np.zeros(len(raw) - n + 1, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + raw[i : len(raw) - n + 1 + i]
            h = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            places.append(h >> np.uint32(32 - (DIMENSIONS - 1).bit_length()))
    return np.concatenate(places) if places else np.zeros(0, np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """A row of square-rooted counts of length one for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        row[:] = np.sqrt(np.bincount(grams(text), minlength=DIMENSIONS))
        if norm := np.sqrt(row @ row):
            row /= norm
    return out


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` labels; columns are distinct, proper splits of the labels."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= EXHAUSTIVE:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, np.float32).T
    rng, best, width = np.random.default_rng(n), None, 8 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = np.where(rng.random((n, width)) < 0.5, 1, -1).astype(np.float32)
        far = width - np.max((code @ code.T - 2 * width * np.eye(n)))
        if np.all(np.abs(code.sum(axis=0)) < n) and (best is None or far > best[0]):
            best = (far, code)
    return best[1]


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if x and _LETTER(x)] if self.labels else []
        for start in range(0, len(known), 256):
            part = known[start : start + 256]
            margins = features([texts[i] for i in part]) @ self.weights + self.bias
            loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            for i, c, p in zip(part, share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.labels[c], p
        return names, scores


def fit(x: np.ndarray, y: list[str]) -> Model:
    """One logistic classifier for each bit of the codewords, by accelerated full-batch descent."""
    labels = sorted(set(y))
    code = codewords(len(labels))
    place = {v: i for i, v in enumerate(labels)}
    target = code[[place[v] for v in y]]
    own = np.array([place[v] for v in y], np.int64)
    share = (1 / (max(len(labels), 1) * np.bincount(own, minlength=len(labels))[own])).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    ahead = w
    for step in range(STEPS if code.shape[1] else 0):
        slope = x.T @ (-target * share[:, None] / (1 + np.exp(np.clip(target * (x @ ahead), -30, 30)))) + PENALTY * ahead
        after = ahead - RATE * slope
        ahead, w = after + step / (step + 3) * (after - w), after
    return Model(labels, code, w[:-1], w[-1])


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL) -> Model:
    """Fit on a sample of about ``per_label`` rows of each non-null label that have a text and an id.

    More than ``MOST_LABELS`` labels raise ``ValueError``.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where("label is not null and text is not null and key is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    spread = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = None
    for name, n in counts.items():
        hit = (F.col("label") == name) & (spread < min(1.0, per_label / n))
        wanted = hit if wanted is None else wanted | hit

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "text"):
                texts = batch.column(0).to_pylist()
                rows, places, values = [], [], []
                for i, text in enumerate(texts):
                    row = features([text])[0]
                    used = np.flatnonzero(row)
                    rows.append(i)
                    places.append(used.astype("<u2").tobytes())
                    values.append(row[used].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["label", "places", "values"])

    sample = rows.where(wanted).select("text", "label").mapInArrow(run, "label string, places binary, values binary").collect()
    sample.sort(key=lambda r: (r["label"], r["places"], r["values"]))
    x = np.zeros((len(sample), DIMENSIONS), np.float32)
    for row, r in zip(x, sample, strict=True):
        row[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["values"], "<f4")
    return fit(x, [r["label"] for r in sample])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, ambiguous`` for every row."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "text"):
                names, scores = model.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([s < AMBIGUOUS for s in scores], pa.bool_())], schema.names)

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, all columns as they are."""
    prepare(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").cast("string").alias("__coterie_text"))

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "__coterie_text"):
                _, scores = model.predict(batch.column(batch.num_columns - 1).to_pylist())
                kept = batch.filter(pa.array([s >= AMBIGUOUS for s in scores], pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return source.mapInArrow(run, docs.schema)
