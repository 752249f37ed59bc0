"""Samples stay bounded and training doesn't fail, however often rows and ids repeat; roles come back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import chat_format, langid, mixing, toxicity
from kerbside.llm.common import class_sample

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def repeated(spark):
    """One labelled id stands on 9001 rows of different texts, beside others."""
    many = spark.range(9001).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("good day number "), "id").alias("text"), F.lit("en").alias("lang"))
    rest = spark.createDataFrame([(i, ("vile awful " if i % 2 else "kind mild ") + f"words {i}", "en" if i % 3 else "de") for i in range(2, 200)] + [(None, "x", None), (500, None, "en")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(2, 200)] + [(1, 1, 0), (1, 1, 0), (500, 1, 1)], "doc_id long, quality int, toxic int")
    return many.unionByName(rest), labels


def test_an_id_on_many_rows(spark, repeated):
    docs, labels = repeated
    out = toxicity.toxicity(docs, labels)
    found = out.groupBy().agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert found[0] == docs.count() and 0 <= found[1] <= found[2] <= 1
    right = out.filter("doc_id between 2 and 199").agg(F.avg((F.col("predicted") == F.col("doc_id") % 2).cast("int"))).first()[0]
    assert right > 0.95
    assert mixing.mixing_rates(docs, labels).count() == docs.count()


def test_long_texts_are_learnt_from(spark):
    """A word that only texts of over 20,000 characters hold is found toxic; texts that don't fit are left out."""
    draw = random.Random(1)
    long = lambda: " ".join(f"w{draw.randrange(500)}" for _ in range(5000))
    rows = [(i, long() + (" brutalword" if i % 2 else " calm"), "en") for i in range(1, 90)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 90)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(spark.createDataFrame([(1, "brutalword"), (2, "calm")], "doc_id long, text string"), model)
    found = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert found[1] > 0.5 > found[2]
    none = toxicity.fit_toxicity(docs, labels, most_chars=100)
    assert isinstance(none, toxicity.TaggerModel)


def test_equal_rows_are_one_of_the_sample(spark):
    one = spark.range(1_000_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    sample, kept = class_sample(one.unionByName(rest), "lang", 1500, "doc_id", "text", repeats=True)
    n = sample.count()
    assert 1000 < n < 2200 and sample.filter("doc_id = 7").count() <= 2 and kept["en"] == pytest.approx(1500 / 4001, rel=0.1)
    model = langid.fit_language_model(one.limit(200_000), 1500, 1)
    assert model.classes == ["en"]


def test_labels_without_bound(spark):
    dirty = spark.range(5000).select("id", F.concat(F.lit("l"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(1)).alias("lang"))
    sample, kept = class_sample(dirty, "lang", 10, "id", classes=20)
    assert len(kept) == 20 and "l1" in kept and sample.filter("lang = 'l1'").count() < 40


def test_training_equals_plain_fit(spark):
    """The model that Spark's rows give is the one that the same examples give in a plain loop."""
    draw = random.Random(2)
    texts = [(i, "".join(draw.choice("abcdefgh " if i % 2 else "ijklmnop ") for _ in range(60)), "ab"[i % 2]) for i in range(40)]
    model = langid.fit_language_model(spark.createDataFrame(texts, DOCS), 1500, 2)
    df = sum((langid.ngram_counts(t) > 0).astype(int) for _, t, _ in texts)
    idf = np.log((1.0 + len(texts)) / (1.0 + df)) + 1.0
    assert model.idf == pytest.approx(idf, rel=1e-6)
    learner, examples = langid.SoftmaxFTRL(langid.DIM + 1, 2), []
    for _, t, lang in sorted(texts, key=lambda r: (r[2], *(x.tobytes() for x in langid.sparse(langid.ngram_counts(r[1]))))):
        at, tf = langid.sparse(langid.ngram_counts(t))
        x = tf * idf.astype(np.float32)[at]
        examples.append((np.append(at, langid.DIM), np.append(x / np.sqrt((x * x).sum()), 1.0).astype(np.float64), "ab".index(lang), 1.0))
    dense = learner.fit(examples, 2)
    assert np.allclose(model.weights, dense[: langid.DIM], atol=1e-5) and np.allclose(model.bias, dense[langid.DIM], atol=1e-5)


def test_roles_of_any_characters(spark):
    draw = random.Random(4)
    some = ["\x00", "\x01", "\\", "n", "\n", "<", "|", "<|im_start|>", "<|im_end|>", ">", "a", "\r", "é"]
    text = lambda: "".join(draw.choices(some, k=draw.randint(0, 9)))
    rows = [(i, t, text(), text()) for i in range(400) for t in range(2)] + [(-1, 0, "a\x00\x01b", "x"), (-2, 0, "a\\nb", "<|im_end|>"), (-3, 0, "a\\\nb", "<|im_start|>")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == {i: [(r, x) for j, _, r, x in rows if j == i] for i in {r[0] for r in rows}}
    assert {r["level"] for r in out} >= {0, 1}
