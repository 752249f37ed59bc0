"""Mixing sources to target weights with soft domain membership.

A classifier learnt from the labelled table gives each document a posterior over domains.
Projected-gradient least squares then fits document rates, not negative, so that the expected
tokens of each domain (rate x tokens x posterior, summed) meet its target. Each step sums one
number per domain over the documents. A document's rate is a function of these sums: tasks
replay the last few steps, and every SEGMENT steps the rates so far are written beside the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .char_features import DIM, ngram_counts, sparse
from .common import bounded, checkpoint, class_sample, fresh, one_text_each, small_batches, slices, unit_hash
from .softmax_ftrl import SoftmaxFTRL, softmax

ANCHOR = 1e-4
STEPS = 60
#: Steps that a task replays at most before the rates are written.
SEGMENT = 10
#: Rows of a task of a step.
STEP_ROWS = 50_000


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, text: str | None) -> np.ndarray:
        at, tf = sparse(ngram_counts(text, letters_only=False))
        norm = float(np.sqrt((tf * tf).sum())) or 1.0
        return softmax(((tf / norm) @ self.weights[at] + self.bias).astype(np.float64))


def fit_domains(docs: DataFrame, labels: DataFrame, per_class: int = 500, epochs: int = 3) -> DomainModel:
    """Learn from about ``per_class`` labelled rows of each domain (language and quality); the
    bias restores the domains' shares. The sample is drawn without texts, and its ids, which
    are bounded, are broadcast to them; an id on many rows gives one text. An id labelled twice has its larger quality and
    language; null texts, languages and qualities are not learnt from; without labelled rows all
    is one domain."""
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    known = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull()).join(marks, F.col("doc_id") == F.col("label_id"))
    known = known.select("label_id", F.concat_ws("/", "lang", F.concat(F.lit("q"), F.col("quality"))).alias("domain")).groupBy("label_id").agg(F.max("domain").alias("domain"))
    chosen, kept = class_sample(known, "domain", per_class, "label_id")
    sample = one_text_each(docs, bounded(chosen, 4 * per_class * max(1, len(kept))), "domain")

    def featurise(batches):
        for whole in batches:
            for batch in slices(whole):
                pairs = [sparse(ngram_counts(t, letters_only=False)) for t in batch.column("text").to_pylist()]
                vectors = (pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("domain"), *vectors], ["domain", "at", "tf"])

    found = sample.select("text", "domain").mapInArrow(featurise, "domain string, at binary, tf binary").collect()  # no more rows than the sample
    if not found:
        return DomainModel(["all"], np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
    domains = sorted({r["domain"] for r in found})
    examples = []
    for r in sorted(found, key=lambda r: (r["domain"], bytes(r["at"]), bytes(r["tf"]))):
        at, tf = np.frombuffer(r["at"], np.int32), np.frombuffer(r["tf"], np.float32)
        x = tf / (float(np.sqrt((tf * tf).sum())) or 1.0)
        examples.append((np.append(at, DIM), np.append(x, 1.0).astype(np.float64), domains.index(r["domain"]), 1.0))
    dense = SoftmaxFTRL(DIM + 1, len(domains), l1=0.02, l2=0.1).fit(examples, epochs)
    shift = np.array([-np.log(kept[d]) for d in domains], np.float32)
    return DomainModel(domains, dense[:DIM], dense[DIM] + shift - shift.mean())


def with_posteriors(docs: DataFrame, model: DomainModel, tokens: str, posterior: str) -> DataFrame:
    """``docs`` with two columns more: the words between white space, and the posterior."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, tokens, posterior]
    schema = StructType([*docs.schema.fields, StructField(tokens, LongType()), StructField(posterior, ArrayType(DoubleType()))])

    def predict(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                p = np.array([m.posterior(t) for t in texts]).reshape(len(texts), len(m.domains))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len((t or "").split()) for t in texts], pa.int64()), lists], names)

    return docs.mapInArrow(predict, schema)


@dataclass
class RateFit:
    domains: list[str]
    available: np.ndarray
    targets: np.ndarray
    step: float
    least: float
    #: gaps of the domains' sums at each step, in shares of the available tokens
    gaps: list[np.ndarray]

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates of rows of posteriors after all steps."""
        return self.replay(p)[0]

    def replay(self, p: np.ndarray, since: int = 0, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The accelerated projected-gradient steps from ``since`` on: (rates, where the next
        gradient is taken)."""
        r, ahead = state or (np.maximum(np.ones(len(p)), self.least),) * 2
        momentum = 1.0
        for n, gap in enumerate(self.gaps):
            after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            if n >= since:
                new = np.maximum(self.least, ahead - self.step * (p @ gap + ANCHOR * (ahead - 1.0)))
                r, ahead = new, new + (momentum - 1) / after * (new - r)
            momentum = after
        return r, ahead


def matrix_of(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(rows: DataFrame, domains: list[str], targets, least: float = 0.0, steps: int = STEPS, tolerance: float = 1e-4) -> RateFit:
    """Fit rates of ``least`` or more to rows of (tokens, posterior), in this order; ``targets``
    maps the available tokens of the domains to those wanted. ``rows`` should be written
    already: each step reads it. Empty rows fit at once."""
    k = len(domains)
    tokens, posterior = rows.columns
    state = rows.select(F.col(tokens).alias("t"), F.col(posterior).alias("p")).coalesce(max(1, rows.count() // STEP_ROWS))  # a step is short: few, large tasks
    sums = lambda df: np.array([x or 0.0 for x in df.first()], float)
    available = sums(state.agg(*[F.sum(F.col("t") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]))
    wanted = np.asarray(targets(available), float)
    live = (available > 0) & (wanted > 0)
    safe = np.where(live, wanted, 1.0)
    # gaps count in units of what a domain has: then no step beyond 1 is safe, and small domains converge too
    has = np.where(live, available, 1.0)
    fit = RateFit(domains, available, wanted, 1.0 / (1.0 + ANCHOR), least, [])

    def stand(batch: pa.RecordBatch, fit: RateFit, since: int) -> tuple:
        p = matrix_of(batch, "p", k)
        if since == 0:
            return p, fit.replay(p)
        return p, fit.replay(p, since, tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in ("r", "ahead")))

    since = 0
    for n in range(steps):
        if n and n % SEGMENT == 0:

            def advance(batches, fit=fit, since=since):
                for batch in batches:
                    _, (r, ahead) = stand(batch, fit, since)
                    yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("p"), pa.array(r), pa.array(ahead)], ["t", "p", "r", "ahead"])

            state = checkpoint(state.mapInArrow(advance, "t long, p array<double>, r double, ahead double"))
            since = n

        def partial(batches, fit=fit, since=since):
            total = np.zeros((2, k))
            for batch in batches:
                if batch.num_rows:
                    t = batch.column("t").to_numpy(zero_copy_only=False)
                    p, (now, ahead) = stand(batch, fit, since)
                    total += np.array([(t * now) @ p, (t * ahead) @ p])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], [f"s{i}" for i in range(2 * k)])

        shape = ", ".join(f"s{i} double" for i in range(2 * k))
        total = sums(state.mapInArrow(partial, shape).agg(*[F.sum(f"s{i}") for i in range(2 * k)])).reshape(2, k)
        if np.max(np.abs(np.where(live, (total[0] - wanted) / safe, 0.0)), initial=0.0) < tolerance:
            break
        fit.gaps.append(np.where(live, (total[1] - wanted) / has, 0.0))
    return fit


def tempered(alpha: float, grow: bool):
    """Targets in proportion to the available tokens to the power ``alpha``: of the same total,
    or, with ``grow``, of the least total for which no domain shrinks."""

    def targets(available: np.ndarray) -> np.ndarray:
        w = np.where(available > 0, np.maximum(available, 1e-12) ** alpha, 0.0)
        if not w.sum():
            return w
        total = np.max(available[w > 0] / w[w > 0]) if grow else available.sum() / w.sum()
        return w * total

    return targets


def rated(rows: DataFrame, fit: RateFit, posterior: str, rate: str, domain: str, share: str) -> DataFrame:
    """``rows`` without its posteriors, and with the rate, the likeliest domain (of ties the
    first by name) and that domain's posterior."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    kept = [f for f in rows.schema.fields if f.name != posterior]
    names = [*(f.name for f in kept), rate, domain, share]
    schema = StructType([*kept, StructField(rate, DoubleType()), StructField(domain, StringType()), StructField(share, DoubleType())])

    def assign(batches):
        f = shared.value
        for batch in batches:
            p = matrix_of(batch, posterior, len(f.domains))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            more = [pa.array(f.rates(p)), pa.array([f.domains[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best])]
            yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in kept), *more], names)

    return rows.mapInArrow(assign, schema)


def copies_of(rate: Column, *keys: str) -> Column:
    """The rate rounded up or down by a hash of the row, so that its mean is the rate."""
    return F.floor(rate + unit_hash(*keys)).cast("long")


def mixing_rates(docs: DataFrame, labels: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_tokens, domain, domain_posterior, rate,
    copies.

    Null and empty texts have no tokens and the prior's posterior; texts of any length are read
    whole; repeated rows have equal rates; an empty table gives an empty one; without labelled
    rows all is one domain and the rates are 1; extra columns are not looked at.
    """
    model = fit_domains(docs, labels)
    rows = checkpoint(with_posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "n_tokens", "posterior").drop("text"))
    fit = fit_rates(rows.select("n_tokens", "posterior"), model.domains, tempered(alpha, grow=False))
    out = rated(rows, fit, "posterior", "rate", "domain", "domain_posterior")
    return out.select("doc_id", "n_tokens", "domain", "domain_posterior", "rate", copies_of(F.col("rate"), "doc_id").alias("copies"))


def mix_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.8) -> DataFrame:
    """``docs`` (all its columns, whatever their names), each row as often as its rate says.

    Rates are 0 or more, and targets are such that no domain shrinks. So that no document is
    lost, rounding gives each at least one copy: a domain ends above its target by what its
    rates below 1 lack. Null and empty texts have no tokens, so the fit leaves them free and
    they stay once or as often as their domain's rate says; repeated rows count each; an
    empty table gives an empty one.
    """
    model = fit_domains(docs, labels)
    tokens, posterior, rate, domain, share, copy = fresh(docs, "tokens", "posterior", "rate", "domain", "share", "copy")
    measured = with_posteriors(docs, model, tokens, posterior)
    fit = fit_rates(checkpoint(measured.select(tokens, posterior)), model.domains, tempered(alpha, grow=True))
    one = F.lit(1).cast("long")
    out = rated(measured, fit, posterior, rate, domain, share).withColumn(copy, F.explode(F.sequence(one, F.greatest(one, copies_of(F.col(rate), "doc_id", "text")))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
