"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The model is trained with follow-the-regularised-leader and elastic-net penalties and then
calibrated by a temperature on held-back rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_features import DIM, has_letter, ngram_counts, sparse
from .common import class_sample, held_out, small_batches, slices
from .softmax_ftrl import SoftmaxFTRL, fit_temperature, softmax


@dataclass
class LanguageModel:
    classes: list
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        norm = float(np.sqrt((x * x).sum())) or 1.0
        return (x / norm) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*sparse(ngram_counts(text))).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each n-gram slot, over all ``rows``; summed in tasks, then by slot."""

    def count(batches):
        df, docs = np.zeros(DIM, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column("text").to_pylist():
                    df += ngram_counts(text) > 0
                    docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["slot", "n"])

    sums = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out, docs = np.zeros(DIM, np.int64), 0
    for slot, n in sums.collect():  # at most DIM + 1 rows
        if slot < 0:
            docs = n
        else:
            out[slot] = n
    return out, docs


def fit_language_model(rows: DataFrame, per_class: int = 1500, epochs: int = 3) -> LanguageModel:
    """Learn from (doc_id, text, lang). Document frequencies cover all rows; the weights are
    fitted on a bounded sample of about ``per_class`` rows of each language, of which equal rows are
    one; of very many languages the most frequent ones are learnt (``class_sample``). Null texts and
    languages are not learnt from; without rows the model knows no language."""
    small_batches(rows.sparkSession)
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample, kept = class_sample(rows.select("doc_id", "text", "lang"), "lang", per_class, "doc_id", "text", repeats=True)
    most = 4 * per_class * max(1, len(kept))

    def featurise(batches):
        for whole in batches:
            for batch in slices(whole):
                pairs = [sparse(ngram_counts(t)) for t in batch.column("text").to_pylist()]
                vectors = (pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), *vectors], ["lang", "at", "tf"])

    found = sample.select("text", "lang").mapInArrow(featurise, "lang string, at binary, tf binary").limit(most + 1).collect()
    if len(found) > most:
        raise RuntimeError(f"more than {most} rows were drawn")  # the hash would have to fail
    if not found:
        return LanguageModel([], np.ones(DIM, np.float32), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32), 1.0)
    df, docs = document_frequencies(rows)
    idf = (np.log((1.0 + docs) / (1.0 + df)) + 1.0).astype(np.float32)
    classes = sorted({r["lang"] for r in found})
    rank = {c: i for i, c in enumerate(classes)}
    examples = []
    for r in sorted(found, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["tf"]))):
        at, tf = np.frombuffer(r["at"], np.int32), np.frombuffer(r["tf"], np.float32)
        x = tf * idf[at]
        x = x / (float(np.sqrt((x * x).sum())) or 1.0)
        # one more slot, always 1, is the bias
        examples.append((np.append(at, DIM), np.append(x, 1.0).astype(np.float64), rank[r["lang"]], 1.0))
    back = examples[::5] if len(examples) >= 50 else []
    front = [e for i, e in enumerate(examples) if i % 5] if back else examples
    learner = SoftmaxFTRL(DIM + 1, len(classes))
    dense = learner.fit(front, epochs)
    model = LanguageModel(classes, idf, dense[:DIM], dense[DIM], 1.0)
    if back:
        logits = np.array([x @ dense[at] for at, x, _, _ in back])
        model.temperature = fit_temperature(logits, np.array([e[2] for e in back]))
    return model


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to (doc_id, held_out, text).

    A null text, or one without a letter, gives ``und`` and 0; texts of any length are read whole;
    of classes that tie the first by name counts; repeated rows give equal rows; an empty table
    gives an empty table; extra columns are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole):
                pairs = [m.predict(t.as_py()) for t in batch.column("text")]
                found = pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *found], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 3, remainder: int = 1, per_class: int = 1500) -> DataFrame:
    """Fit on rows outside the held-out fold, then predict every row: doc_id, held_out, lang_pred,
    score. Rows with a null text, language or id are not learnt from; all rows are predicted, as
    ``identify_languages`` says."""
    rows = docs.select("doc_id", "text", "lang", held_out(modulus, remainder).alias("held_out"))
    model = fit_language_model(rows.filter(~F.col("held_out")), per_class)
    return identify_languages(rows, model)
