"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from document labels: affixes and words that a greedy cover finds in
toxic documents and not in clean ones mark the toxic tokens. The field has two tags and
hashed word and prefix features; a text is one chain, however long. Forward-backward marginals
give token probabilities; their largest value and their sum give the document's score through a
logistic link, and tokens of at least one half give the offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import bounded, checkpoint, class_sample, fresh, held_out, one_text_each, small_batches, slices, unit_hash

WORD = re.compile(r"\w+")
BITS = 20
#: Chains are worked on in blocks of so many tokens side by side; messages pass from block to block.
BLOCK = 64
PREFIXES = (3, 4, 5, 6)
#: Words whose potentials a task remembers. It sets the speed only.
CACHED_WORDS = 250_000
#: Texts of more characters are split into words one by one rather than at once.
LONG = 1 << 20


def affixes(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:k] for k in PREFIXES if len(word) > k]


EQUAL, CARET, SLOTS = crc32(b"="), crc32(b"^"), (1 << BITS) - 1


def feature_ids(word: str) -> list[int]:
    """Hashed slots of the word's affixes; a prefix's hash goes on from that of the shorter one."""
    whole = word.encode("utf-8", "surrogatepass")
    out = [crc32(whole, EQUAL) & SLOTS]
    size, parts = len(word), whole if len(whole) == len(word) else None
    code, at = CARET, 0
    for k in PREFIXES:
        if size <= k:
            break
        code = crc32(parts[at:k] if parts is not None else word[at:k].encode("utf-8", "surrogatepass"), code)
        out.append(code & SLOTS)
        at = k
    return out


@dataclass
class TaggerModel:
    weights: np.ndarray
    start: float
    #: log potentials of (outside to toxic), (toxic to outside), (toxic to toxic); the rest is 0
    moves: np.ndarray
    bias: float
    #: the document's link: intercept, weight of the largest marginal, weight of the sum
    link: tuple = (0.0, 1.0, 0.0)


class EmissionCache(dict):
    """Word to its log potential for the toxic tag; forgotten when it holds too many words."""

    def __init__(self, model: TaggerModel):
        super().__init__()
        self.weights, self.bias = memoryview(model.weights), model.bias

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self.bias
        for i in feature_ids(word.lower()):
            value += self.weights[i]
        self[word] = value
        return value


class Chains:
    """Messages of forward-backward for many chains at once, exact for chains of any length.

    With tags outside and toxic, a step maps (outside, toxic) by the matrix [[1, down], [up,
    stay]], the second row times the token's potential. Chains are laid out in columns of BLOCK
    tokens. The products of a column's matrices carry messages over whole columns, column by
    column for all chains together; then all columns are walked token by token side by side.
    """

    def __init__(self, values: list[np.ndarray], start: float, moves: np.ndarray):
        self.lengths = np.array([len(v) for v in values], int)
        columns = -(-self.lengths // BLOCK)
        self.first = np.cumsum(columns) - columns  # each chain's first column
        size = int(columns.sum())
        flat = np.full(size * BLOCK, np.nan)
        for v, at in zip(values, self.first * BLOCK):
            flat[at : at + len(v)] = v
        emission = flat.reshape(size, BLOCK).T
        self.real = ~np.isnan(emission)
        e = np.exp(np.clip(np.where(self.real, emission, 0.0), -40, 40))
        up, down, stay = np.exp(moves)
        # a place after the end changes nothing; a chain's first token has no step before it
        self.up = np.where(self.real, e * up, 0.0)
        self.down = np.where(self.real, down, 0.0)
        self.stay = np.where(self.real, e * stay, 1.0)
        heads = self.first[self.lengths > 0]
        self.up[0, heads] = e[0, heads] * np.exp(start)
        self.down[0, heads] = self.stay[0, heads] = 0.0
        self.opening = np.zeros((BLOCK, size), bool)
        self.opening[0, heads] = True
        self.entering, self.leaving = np.zeros(size), np.ones(size)
        if size and columns.max() > 1:
            self.carry(columns)
        self.walk()

    def carry(self, columns: np.ndarray) -> None:
        """Messages into each column from the columns before it and after it."""
        size = self.up.shape[1]
        a, b, c, d = np.ones(size), np.zeros(size), np.zeros(size), np.ones(size)
        for t in range(BLOCK):
            up, down, stay = self.up[t], self.down[t], self.stay[t]
            a, b, c, d = a + down * c, b + down * d, up * a + stay * c, up * b + stay * d
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
        order = np.argsort(-columns, kind="stable")
        first, count = self.first[order], columns[order]
        outside, toxic = np.ones(len(order)), np.zeros(len(order))
        for k in range(int(count[0]) - 1):
            at = first[: int((count > k + 1).sum())] + k
            o, x = outside[: len(at)], toxic[: len(at)]
            o, x = a[at] * o + b[at] * x, c[at] * o + d[at] * x
            outside, toxic = o / (o + x), x / (o + x)
            self.entering[at + 1] = toxic / outside
        # backwards: of each chain the k-th column from its end
        outside, toxic = np.ones(len(order)), np.ones(len(order))
        for k in range(int(count[0]) - 1):
            live = count > k + 1
            at = (first + count - 1 - k)[live]
            o, x = outside[live[: len(outside)]], toxic[live[: len(toxic)]]
            o, x = a[at] * o + c[at] * x, b[at] * o + d[at] * x
            outside, toxic = o / (o + x), x / (o + x)
            self.leaving[at - 1] = toxic / outside

    def walk(self) -> None:
        """Ratios of toxic to outside: before each token, up to it, and of what follows it."""
        self.before, self.upto, self.after = np.empty_like(self.up), np.empty_like(self.up), np.empty_like(self.up)
        ratio = self.entering
        for t in range(BLOCK):
            self.before[t] = ratio
            ratio = (self.up[t] + self.stay[t] * ratio) / (1.0 + self.down[t] * ratio)
            self.upto[t] = ratio
        ratio = self.leaving
        for t in range(BLOCK - 1, -1, -1):
            self.after[t] = ratio
            ratio = (self.down[t] + self.stay[t] * ratio) / (1.0 + self.up[t] * ratio)

    def marginals(self) -> np.ndarray:
        odds = self.upto * self.after
        return odds / (1.0 + odds)

    def moves(self) -> np.ndarray:
        """Expected numbers of the moves up, down and stay."""
        weights = np.stack([self.up * self.after, self.down * self.before, self.stay * self.before * self.after])
        inside = self.real & ~self.opening
        return np.array([(w / (1.0 + weights.sum(axis=0)))[inside].sum() for w in weights])

    def of_chains(self, table: np.ndarray) -> list[np.ndarray]:
        flat = table.T.reshape(-1)
        return [flat[at : at + n] for at, n in zip(self.first * BLOCK, self.lengths)]


def emissions(text: str | None, cache: EmissionCache) -> np.ndarray:
    """Log potentials of the text's words."""
    if text is None or len(text) <= LONG:
        return np.fromiter(map(cache.__getitem__, WORD.findall(text or "")), float)
    return np.fromiter((cache[m.group()] for m in WORD.finditer(text)), float)


def document_marginals(texts: list, model: TaggerModel, cache: EmissionCache) -> list[np.ndarray]:
    """Token probabilities of each text; a null text has no tokens."""
    chains = Chains([emissions(t, cache) for t in texts], model.start, model.moves)
    return chains.of_chains(chains.marginals())


def document_features(marginals: np.ndarray) -> tuple[float, float]:
    if len(marginals) == 0:
        return -12.0, 0.0
    top = float(np.clip(marginals.max(), 6e-6, 1 - 6e-6))
    return float(np.log(top / (1 - top))), float(np.log1p(marginals[marginals > 0.01].sum()))


def document_score(features: tuple[float, float], link: tuple) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(link[0] + link[1] * features[0] + link[2] * features[1], -500, 500))))


def offending_spans(text: str, marginals: np.ndarray) -> str:
    """start:end of runs of toxic tokens, in code points of the text."""
    spans: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if marginals[i] >= 0.5:
            if last == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in spans)


# --- learning -------------------------------------------------------------------------


def merge_copies(documents: list[list[str]], hashes: int = 4) -> list[set]:
    """Word sets of the documents, those of (near) copies joined into one, so that a text that
    is often repeated counts once. Copies share one of a few MinHash values of word triples."""
    parent = list(range(len(documents)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, words in enumerate(documents):
        code = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        width = min(3, len(code))
        if width == 0:
            continue
        triples = np.zeros(len(code) - width + 1, np.uint64)
        for k in range(width):
            triples = (triples ^ code[k : len(code) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(hashes):
            least = int(((triples ^ (triples >> np.uint64(29 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)).min())
            parent[root(i)] = root(seen.setdefault((k, least), i))
    merged: dict[int, set] = {}
    for i, words in enumerate(documents):
        merged.setdefault(root(i), set()).update(words)
    return list(merged.values())


def find_cues(toxic: list[set], clean: list[set]) -> set[str]:
    """Affixes that cover toxic documents and (almost) no clean one, most covering first."""
    least = max(3, len(toxic) // 250)
    # a document's affixes are many: they are made twice rather than held
    of = lambda words: {a for w in words for a in affixes(w)}
    of_clean = Counter(f for words in clean for f in of(words))
    of_toxic = Counter(f for words in toxic for f in of(words))
    odds = (len(clean) + 1) / (len(toxic) + 1)
    good = {f for f, n in of_toxic.items() if n >= least and n * odds >= 30 * (of_clean[f] + 0.3)}
    cues: set[str] = set()
    left = [of(words) & good for words in toxic]
    while True:
        gain = Counter(f for s in left for f in s)
        if not gain:
            break
        # of equal gains the shorter affix, since it covers unseen words too
        best = min(gain, key=lambda f: (-gain[f], of_clean[f], len(f), f))
        if gain[best] < least:
            break
        cues.add(best)
        left = [s for s in left if best not in s]
    strong = {f for f in good if of_toxic[f] >= max(15, 0.005 * len(toxic)) and of_clean[f] == 0}
    return cues | strong


def fit_tagger(toxic: list[str], clean: list[str], passes: int = 8, batch_tokens: int = 65_536, seed: int = 7) -> TaggerModel:
    """Train the field on the labelled documents, each a chain, by stochastic gradient ascent."""
    one: dict[str, str] = {}
    split = lambda t: [one.setdefault(w, w) for w in (m.lower() for m in WORD.findall(t))]  # noqa: E731  one object for each word
    toxic_words, clean_words = [split(t) for t in toxic], [split(t) for t in clean]
    cues = find_cues(merge_copies(toxic_words), merge_copies(clean_words))
    whole = np.zeros((1 << BITS) + 1)  # the last slot is padding
    start, moves, bias = -3.0, np.array([-3.0, 0.0, 0.0]), -3.0
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in (*toxic_words, *clean_words) for w in c))}
    is_cue = np.array([any(a in cues for a in affixes(w)) for w in vocabulary], bool)
    ids = [np.fromiter(map(vocabulary.__getitem__, c), np.int32, len(c)) for c in (*toxic_words, *clean_words) if c]
    labels = [True for c in toxic_words if c] + [False for c in clean_words if c]
    if not any(y and is_cue[x].any() for x, y in zip(ids, labels)):
        return TaggerModel(whole[:-1].astype(np.float32), start, moves, bias)
    gold = [is_cue[x] & y for x, y in zip(ids, labels)]
    width = len(PREFIXES) + 1
    features = np.full((len(vocabulary), width), 1 << BITS)
    for i, w in enumerate(vocabulary):
        own = feature_ids(w)
        features[i, : len(own)] = own
    del one, vocabulary, toxic_words, clean_words
    used, features = np.unique(np.vstack([features, np.full((1, width), 1 << BITS)]), return_inverse=True)
    features = features.reshape(-1, width)[:-1]
    weights = np.zeros(len(used))
    squares, others, other_squares = np.full(len(weights), 1e-2), np.array([start, *moves, bias]), np.full(5, 1e-2)
    draw, rate, decay = np.random.default_rng(seed), 0.3, 1e-6
    for _ in range(passes):
        order = draw.permutation(len(ids))
        ends = np.searchsorted(np.cumsum([len(ids[i]) for i in order]), np.arange(1, 1 << 31, batch_tokens)[: 1 + sum(map(len, ids)) // batch_tokens])
        for rows in filter(len, np.split(order, ends[1:])):
            x, y = np.concatenate([ids[i] for i in rows]), np.concatenate([gold[i] for i in rows]).astype(float)
            word_value = weights[features].sum(axis=1) + others[4]
            chains = Chains([word_value[ids[i]] for i in rows], others[0], others[1:4])
            p = np.concatenate(chains.of_chains(chains.marginals()))
            share = 8 * BLOCK / len(x)
            per_word = np.bincount(x, y - p, len(features))
            g = np.bincount(features.ravel(), np.repeat(per_word, width), len(weights)) * share - decay * weights
            g[-1] = 0.0
            squares += g * g
            weights += rate * g / np.sqrt(squares)
            head = np.cumsum([0, *(len(ids[i]) for i in rows[:-1])])
            inside = np.ones(len(x), bool)
            inside[head] = False
            now, last = y[inside], y[:-1][inside[1:]]
            seen = np.array([((1 - last) * now).sum(), (last * (1 - now)).sum(), (last * now).sum()])
            go = np.array([(y - p)[head].sum(), *(seen - chains.moves()), (y - p).sum()]) * share
            other_squares += go * go
            others += rate * go / np.sqrt(other_squares)
    whole[used] = weights
    return TaggerModel(whole[:-1].astype(np.float32), float(others[0]), others[1:4].copy(), float(others[4]))


def fit_link(features: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple:
    """Logistic link of the document's two features by damped Newton steps, slopes not negative."""
    x = np.column_stack([np.ones(len(features)), features])
    b = np.array([0.0, 0.5, 0.1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (labels - p)) - 0.5 * np.array([0, b[1], b[2]])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.5, 0.5])
        b = b + np.clip(np.linalg.solve(h, g), -1, 1)
        b[1:] = np.maximum(b[1:], 0.01)
    return tuple(map(float, b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = 2000, most_chars: int = 16_000_000) -> TaggerModel:
    """Learn from the labelled rows outside the held-out fold, on a bounded sample of about
    ``per_class`` rows of each label; the link is fitted with weights that restore the labels' true
    shares. The sample is drawn from the labels alone and its ids, which are bounded, are
    broadcast to the texts; an id on many rows gives one text. Texts are taken in the order of a
    hash of their ids while all together have at most ``most_chars`` characters, so that no length is
    favoured; one that doesn't fit is left out. Null labels and texts are not learnt from; of an
    id labelled twice the toxic label counts; without both labels the model finds nothing."""
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(modulus, remainder)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("label"))
    sample, kept = class_sample(marks, "label", per_class, "label_id")
    texts = checkpoint(one_text_each(docs, bounded(sample, 4 * per_class), "label"))
    room, ids = most_chars, []
    for r in texts.select("label_id", F.length("text").alias("n")).orderBy(unit_hash("label_id"), "label_id").collect():  # no more rows than the sample
        if r["n"] <= room:
            room -= r["n"]
            ids.append((r["label_id"],))
    chosen = docs.sparkSession.createDataFrame(ids, "chosen long")
    found = sorted((r["label"], r["text"]) for r in texts.join(F.broadcast(chosen), F.col("label_id") == F.col("chosen")).select("label", "text").collect())
    toxic, clean = [t for y, t in found if y == 1], [t for y, t in found if y == 0]
    if not toxic or not clean:
        return TaggerModel(np.zeros(1 << BITS, np.float32), -3.0, np.array([-3.0, 0.0, 0.0]), -8.0)
    model = fit_tagger(toxic, clean)
    cache = EmissionCache(model)
    labels_found = np.array([y for y, _ in found], float)
    features = np.array([document_features(document_marginals([t], model, cache)[0]) for _, t in found])
    model.link = fit_link(features, labels_found, np.array([1 / kept[y] for y, _ in found]))
    return model


def tagged_slices(batches, model: TaggerModel):
    """Bounded slices of Arrow batches, with the token probabilities of each text."""
    cache = EmissionCache(model)
    for whole in batches:
        for batch in slices(whole):
            texts = batch.column("text").to_pylist()
            yield batch, texts, document_marginals(texts, model, cache)


def score_toxicity(docs: DataFrame, model: TaggerModel) -> DataFrame:
    """Add ``score``, ``predicted`` and ``toxic_spans`` (start:end, comma-joined) to every row.

    Other columns pass through; where one has such a name, the added column gets an
    underscore. A null or empty text has no spans and the score of a document without toxic tokens;
    texts of any length are tagged whole, as one chain; equal texts have equal scores; repeated
    rows give equal rows; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = fresh(docs, "score", "predicted", "toxic_spans")
    names = [*docs.columns, *added]
    schema = StructType([*docs.schema.fields, *(StructField(n, kind) for n, kind in zip(added, (DoubleType(), IntegerType(), StringType())))])

    def score(batches):
        for batch, texts, found in tagged_slices(batches, shared.value):
            scores = [document_score(document_features(p), shared.value.link) for p in found]
            spans = [offending_spans(t, p) if len(p) and p.max() >= 0.5 else "" for t, p in zip(texts, found)]
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = 2000) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, then score every row of ``docs``: doc_id,
    held_out, score, predicted, toxic_spans. Nulls, empty and long texts, ties, repeats and empty
    tables are as in ``fit_toxicity`` and ``score_toxicity``; extra columns are not looked at."""
    model = fit_toxicity(docs, labels, modulus, remainder, per_class)
    return score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), "text"), model).drop("text")


def reject_toxic(docs: DataFrame, model: TaggerModel) -> DataFrame:
    """``docs`` (all its columns, whatever their names) without the documents that score one half
    or more. Null and empty texts have no toxic token and stay; equal texts stay or go together;
    repeated rows stay as often; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch, _, found in tagged_slices(batches, shared.value):
            yield batch.filter(pa.array([document_score(document_features(p), shared.value.link) < 0.5 for p in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
