"""Token counts and packing against the tokenizers' own whole-text results."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from kerbside.llm import packing, token_counts

ALPHABET = ["a", "b", "the", "ing", "***", "$", "|>", "_", " ", "  ", "\n", "\t", "▁", ".", "é", "é", "ß", "Σ", "ΑΣ", "中", "\U0001f600", "<s>", "<|endoftext|>", "<|startoftext|>", "'s", "1", "23", "\xa0", "\x1c", "　", "\r\n", "\x00", "İ", "ﬁ", "K"]


def random_texts(n, seed):
    draw = random.Random(seed)
    return ["", " ", "\n", " \n ", "a ", " a", "\na", "a\n\nb", *("".join(draw.choices(ALPHABET, k=draw.randint(1, 30))) for _ in range(n))]


def test_counts_equal_whole_encoding():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.load_model(path)
    lengths = token_counts.PartLengths(path)
    assert token_counts.is_splittable(model)
    for text in random_texts(3000, 1):
        assert token_counts.count_tokens(text, lengths) == len(model.encode(text)), repr(text)
    assert token_counts.count_tokens(None, lengths) == 0


def test_ids_equal_whole_encoding():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.load_tokenizer(path)
    parts = packing.PartIds(path)
    for text in random_texts(3000, 2):
        ids = np.frombuffer(packing.document_ids(text, parts), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_words_in_any_case_with_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, parts = packing.load_tokenizer(path), packing.PartIds(path)
    draw = random.Random(5)
    letters = "abcXYZéÉñÑßöÖŉıİſǅĿŒ\u0250ΣK" + ".,;:!?'-_1"
    latin = "abcXYZéÉñÑßöÖª²µÿ" + ".,;:!?'-_1"
    texts = [" ".join("".join(draw.choices(latin, k=draw.randint(1, 8))) + draw.choice(["", ".", "?!", ",", "'s.", ".***", "_$", "|>", "'"]) for _ in range(6)) for _ in range(6000)]
    texts += [" ".join("".join(draw.choices(letters, k=draw.randint(1, 8))) + draw.choice(["", ".", "?!", ","]) for _ in range(6)) for _ in range(4000)]
    for text, ids in zip(texts, packing.ids_of_texts(texts, parts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 2047, 2048, 2049, 5000])
def test_pieces_are_powers_of_two(n):
    pieces = packing.piece_lengths(n)
    assert sum(pieces) == n
    assert all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
    assert pieces == sorted(pieces, reverse=True)


def rows_of(spark):
    return spark.createDataFrame([(1, "one two  three"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 6000)], "doc_id long, text string")


def test_token_counts_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts.token_counts(rows_of(spark), path).collect()
    assert len(out) == 6
    by = {r["doc_id"]: r for r in out}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[2]["n_bytes"] == 0
    assert by[4]["over_limit"] and by[4]["n_bytes"] == 30000
    assert token_counts.token_counts(rows_of(spark).limit(0), path).count() == 0


def test_packing_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(rows_of(spark), path).toPandas()
    assert out["sequence_id"].is_unique and (out["offset"] == 0).all()
    whole = packing.load_tokenizer(path)
    long = out[out["doc_id"] == 4].sort_values("start")
    ids = np.array(whole.encode("word " * 6000, add_special_tokens=False).ids + [1], "<u4")
    at = 0
    for r in long.itertuples():
        assert r.start == at and r.doc_tokens == len(ids)
        assert r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
        at += r.length
    assert at == len(ids)
    assert out[out["doc_id"] == 2][["start", "length", "doc_tokens"]].values.tolist() == [[0, 1, 1]]
    assert len(out[out["doc_id"] == 3]) == 2
    assert packing.pack_documents(rows_of(spark).limit(0), path).count() == 0
