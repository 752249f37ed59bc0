"""Decontamination, lexical ranks and turn repair against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from kerbside.llm import decontaminate, lexical_rank, turn_repair

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, n_words long, spans string, items int, salt int, rank int, score long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5) for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, words string")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    some = ["ab", "Ab", "abc", "é", "É", "x1", "the", "THE", "longerword", "日本"]
    line = lambda n: "".join(draw.choice(some) + draw.choice([" ", "  ", ", ", "\n", "-", "\0"]) for _ in range(n))
    bench = [(i, line(draw.choice([0, 1, 2, 9, 10, 11, 30]))) for i in range(25)] + [(3, "ab the"), (3, "ab the"), (None, line(12)), (40, None), (41, line(2500)), (42, "ab " * 12)]
    docs = [(i, line(draw.choice([0, 1, 5, 40, 300]))) for i in range(60)]
    docs += [(100 + n, line(7) + (t or "") + line(4)) for n, (_, t) in enumerate(bench)] + [(7, "again " + bench[41 % 25][1]), (None, bench[27][1]), (8, None), (8, None), (9, "ab " * 30000)]
    return docs, bench


def brute_windows(docs, bench, width=10):
    windows = {}
    for item, t in bench:
        w = words(t)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[at : at + k]))) is not None:
                    hit.update(range(at, at + k))
                    found |= x
        names = sorted(str(x) for x in found if x is not None)
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 3000])
def test_windows_brute(spark, texts, block):
    docs, bench = texts
    found = decontaminate.find_windows(documents(spark, docs), items(spark, bench), block_bytes=block)
    assert found.columns == [*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "n_words_", "spans_", "items_"]
    got = sorted((str(r["doc_id"]), r["n_words_"], sum(s["end"] - s["start"] for s in r["spans_"]), len(r["items_"]), hashlib.sha256(",".join(r["items_"]).encode()).hexdigest(), bool(r["spans_"])) for r in found.collect())
    assert got == brute_windows(docs, bench)


def test_windows_of_empty_tables(spark, texts):
    docs, bench = documents(spark, texts[0]), items(spark, texts[1])
    out = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(out) == len(texts[0]) and not any(r["contaminated"] for r in out) and {r["doc_id"]: r["n_words"] for r in out}[9] == 30000
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in brute_windows(*texts))


def test_shifts_skip_most_positions():
    draw = np.random.default_rng(1)
    text = b" " + b" ".join(b"%x" % n for n in draw.integers(1 << 12, 1 << 20, 20000)) + b" "
    rows = [("a", (b" " + b" ".join(b"%x" % n for n in draw.integers(1 << 12, 1 << 20, 12)) + b" ").decode()) for _ in range(50)]
    bench = decontaminate.Benchmark.of(rows, 10)
    windows = bench.classes[0][0]
    looked = []
    slots = windows.slots
    windows.slots = lambda block: looked.append(len(block)) or slots(block)
    windows.possible_ends(decontaminate.loads(text + decontaminate.PAD), len(text))
    assert sum(looked) < len(text) / 10


def brute_ranks(docs, bench, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    queries: dict = {}
    for item, t in bench:
        queries.setdefault(item, Counter()).update(terms(t))
    out = []
    for item, q in queries.items():
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if c[t])
            scored.append((-score, i is None, i or 0, i))
        out += [(str(item), r + 1, str(i), -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [lexical_rank.BLOCK_TERMS, 30])
def test_ranks_brute(spark, texts, block):
    docs, bench = texts
    got = lexical_rank.rank_documents(documents(spark, docs), items(spark, bench), block_terms=block)
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in got.collect()) == brute_ranks(docs, bench)


def test_ranks_of_empty_tables(spark, texts):
    docs, bench = documents(spark, texts[0]), items(spark, texts[1])
    assert lexical_rank.rank_documents(docs, bench.limit(0)).count() == 0 == lexical_rank.rank_documents(docs.limit(0), bench).count()


def test_ties_beyond_the_last_rank():
    best = lexical_rank.Best(1, 3)
    for ids in ([9, 4], [7, 2, 8], [1]):
        best.add(0, np.full(len(ids), 5), np.array(ids), np.zeros(len(ids), bool))
    assert best.ids[0].tolist() == [1, 2, 4]


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_repair(rows):
    """All edit strings by a plain search over (row, state), least cost then least letters."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for i in range(len(rows), -1, -1):
        for sweep in range(4):
            for q in nexts:
                options = [(0, "", [])] if i == len(rows) and q in ("", "a") else []
                ways = [(3, "I", "user:", nexts[q].get("u")), (3, "I", "assistant:", nexts[q].get("a"))]
                options += [(c + best[i, to][0], x + best[i, to][1], [line, *best[i, to][2]]) for c, x, line, to in ways if to and (i, to) in best]
                if i < len(rows):
                    role, text = rows[i][2:]
                    more = 3 if faults[i] == "truncated" else 0
                    options.append((4 + best[i + 1, q][0], "D" + best[i + 1, q][1], best[i + 1, q][2]))
                    if faults[i] not in ("blank", "duplicate"):
                        ways = [(more, "K", role, nexts[q].get(role[:1]))] + [(3 + more, "R", r, nexts[q].get(r[0])) for r in ("user", "assistant")]
                        options += [(c + best[i + 1, to][0], x + best[i + 1, to][1], [f"{r}:{text}", *best[i + 1, to][2]]) for c, x, r, to in ways if to]
                if options:
                    best[i, q] = min(options + ([best[i, q]] if (i, q) in best else []))
        best = {k: v for k, v in best.items() if k[0] == i}
    cost, audit, lines = best[0, ""]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, place string, found int, audit string")


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(3)
    bodies = ["Yes.", "No!", "Well", "a. b", "", None, " \t", "So?", "long " * 3000 + ".", "é", "É?\n", " ", "x. "]
    rows = [(c, draw.choice([None, *range(12)]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]), draw.choice(bodies)) for c in range(150) for _ in range(draw.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in range(5)] + [(-1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(9000)] + [(-2, 5, "user", "same.")] * 700
    return rows


def test_repair_brute(spark, talks):
    turns = turns_of(spark, talks)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_digests(turn_repair.damaged(turns), turns).collect()}
    held: dict = {r[0]: [] for r in talks}
    for r in damaged_rows(talks):
        held[r[0]].append(r)
    assert got == {c: brute_repair(rows) for c, rows in held.items()}
    assert turn_repair.repair_digests(turns.limit(0), turns.limit(0)).count() == 0 == turn_repair.repaired_turns(turns.limit(0)).count()


def test_repaired_turns_alternate(spark, talks):
    turns = turns_of(spark, talks).filter("conv_id between 0 and 60")
    found: dict = {}
    for r in turn_repair.repaired_turns(turns).collect():
        found[r["conv_id"]] = found.get(r["conv_id"], "") + r["role"][0]
        assert (r["edit"] == "I") <= (r["text"] == "")
    assert found and all(re.fullmatch("s?(ua)+", x) for x in found.values())


def test_least_letters_across_blocks(monkeypatch):
    draw = random.Random(9)
    codes = ["".join(draw.choice("suaoSUAOx") for _ in range(n)) for n in (0, 1, 2, 3, 7, 40, 200)]
    whole = [turn_repair.cheapest_edits(c) for c in codes]
    monkeypatch.setattr(turn_repair, "ROWS_OF_BLOCK", 3)
    assert [turn_repair.cheapest_edits(c) for c in codes] == whole
