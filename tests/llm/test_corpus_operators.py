"""The corpus operators against brute force, on awkward rows and on the small tables."""

import hashlib
import re
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbside.llm import chat_format, exact_dedup, langid, mixing, near_dup, queries, secret_scan, topk_search, toxicity
from kerbside.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, candidate string, key long, digest string, label string, label_id long, gone_id long"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000
ROWS = [(1, "Same text HERE", "en"), (2, "same TEXT here", "en"), (2, "same TEXT here", "en"), (3, None, None), (4, "", "de"), (None, "no id", "en"), (5, LONG, "fr"), (6, LONG + " tail", None), (7, "É É", "fr")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, x, None, None, "x", 1, "d", "l", 2, 3) for i, t, x in ROWS], SCHEMA)


def labels_of(spark, rows=((1, 1, 0), (2, None, 1), (None, 0, 1), (9, 1, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_exact_dedup_brute(spark, awkward):
    fold = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(fold(t), []).append(i)
    out = exact_dedup.exact_dedup(awkward).collect()
    assert len(out) == len(ROWS)
    digests = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = digests[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
    kept = exact_dedup.drop_repeats(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint64).reshape(-1, 4)
    slots = exact_dedup.PerfectHash(keys).slots(keys)
    assert sorted(slots) == list(range(5000))


def brute_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        )
    ):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secrets_brute(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    extra = [(-1, "x" * 70000 + " Token = 'abcDEF123456' AKIA" + "A1" * 9 + " \U0001f600 " + "0f" * 20), (-2, None), (-3, "password: short secret=longenough1 AKIAAKIA" + "B" * 12), (-3, ""), (None, "api_key=" + "z" * 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((str(i), hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t in texts)
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in secret_scan.secret_digests(docs).collect())
    assert got == want
    assert secret_scan.secret_digests(docs.limit(0)).count() == 0


def test_near_duplicates_brute(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    words = near_dup.WordHashes()
    sets = {r["doc_id"]: set(near_dup.shingles(r["text"], words).tolist()) for r in docs.collect()}
    parent = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        both = sets[a] & sets[b]
        if sets[a] and len(both) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and both:
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (root(i), links[i]) for i in sets}


def test_near_duplicates_awkward(spark, awkward):
    out = near_dup.near_duplicates(awkward).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["class_size"] == 3
    assert by[5]["class_id"] == by[6]["class_id"] == 5 and by[3]["n_links"] == 0
    assert near_dup.near_duplicates(awkward.limit(0)).count() == 0


def brute_top_k(rows, k=20, every=20):
    whole = [(i, None if x is None or any(c is None or not np.isfinite(c) for c in x) else [int(np.floor(64 * c)) if abs(c) < 2**46 else int(c) * 64 for c in x]) for i, x in rows]
    out = []
    for at, (q, v) in enumerate(whole):
        if v is not None and q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), 2**63 if o is None else o) for n, (o, w) in enumerate(whole) if n != at and w is not None and len(w) == len(v))
            out += [(q, r + 1, None if o == 2**63 else o, max(min(-s, 2**63 - 1), topk_search.NONE)) for r, (s, o) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_top_k_brute(spark):
    nan = float("nan")
    rows = [(i, [float((i * 7 + k * 3) % 11) / 8 - 0.6 for k in range(6)]) for i in range(300)] + [(400, None), (420, [nan] * 6), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (460, [1.0] * 4), (480, [float("inf")] * 6)]
    rows += [(20, [0.5] * 6), (20, [0.25] * 6), (21, [1.5] * 6), (21, [1.5] * 6)]  # ids repeat, with other vectors and with the same
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("key", F.lit("x"))
    assert sorted(map(tuple, topk_search.top_k(df).collect()), key=str) == brute_top_k(rows)
    # several shards and blocks, so that floors pass from one round to the next
    assert sorted(map(tuple, topk_search.top_k(df, shard=40, block=4).collect()), key=str) == brute_top_k(rows)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(20, [2.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [-4.0, 1.0e30]), (3, [1.0, 1.0]), (40, [1.0, -1.0]), (60, [3.0e9, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(df).collect()), key=str) == brute_top_k(rows)


def test_tree_skips_what_cannot_matter():
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 40, (30, 8))
    points = np.floor(np.repeat(centres, 100, axis=0) + draw.normal(0, 1, (3000, 8)))
    queries, best = points[::60], topk_search.Best(5, np.full(50, topk_search.NONE))
    keys = np.arange(3000)
    made = topk_search.search_tree(points, keys, keys, queries, keys[::60], best, leaf=50)
    exact = (queries @ points.T).astype(np.int64)
    exact[np.arange(50), keys[::60]] = topk_search.NONE
    assert (np.sort(exact, axis=1)[:, :-6:-1] == best.scores).all() and made < 0.5 * exact.size


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nx"), (1, 1, "assistant", r"a <\|im_end|> b <\\| c"), (2, 0, None, None), (2, 0, None, None), (3, 0, "assistant", ""), (3, 1, "assistant", "t\n" * 5000), (None, 0, "role\nline", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("x"))
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in out.items()} == want
    d = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_conversations(df)).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and d[3]["loss_chars"] == 10000
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_toxicity(spark, awkward):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(found[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) >= 0.95
    out = toxicity.toxicity(awkward, labels_of(spark)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(awkward.limit(0), labels_of(spark)).count() == 0


def test_marginals_equal_enumeration():
    start, moves, draw = -0.5, np.array([-0.7, 0.2, 0.9]), np.random.default_rng(5)
    values = [draw.normal(0, 2, n) for n in (1, 4, 0, 7)]
    chains = toxicity.Chains(values, start, moves)
    expected = np.zeros(3)
    for e, p in zip(values, chains.of_chains(chains.marginals())):
        total, on, moved = 0.0, np.zeros(len(e)), np.zeros(3)
        for tags in range(1 << len(e) if len(e) else 0):
            y = [(tags >> k) & 1 for k in range(len(e))]
            steps = [{(0, 1): 0, (1, 0): 1, (1, 1): 2}.get((y[k], y[k + 1])) for k in range(len(e) - 1)]
            w = np.exp(y[0] * start + np.dot(y, e) + sum(moves[m] for m in steps if m is not None))
            total, on = total + w, on + w * np.array(y)
            for m in steps:
                if m is not None:
                    moved[m] += w
        if len(e):
            assert p == pytest.approx(on / total)
            expected += moved / total
    assert chains.moves() == pytest.approx(expected)


def test_one_chain_across_columns():
    """A chain of several columns has the marginals of the plain recursion."""
    draw = np.random.default_rng(6)
    start, moves = -0.3, np.array([-1.0, 0.4, 1.1])
    up, down, stay = np.exp(moves)
    for n in (63, 64, 65, 640, 1000):
        e = draw.normal(0, 2, n)
        forward, back = np.zeros((n, 2)), np.ones((n, 2))
        forward[0] = 1.0, np.exp(e[0] + start)
        for t in range(1, n):
            o, x = forward[t - 1] / forward[t - 1].sum()
            forward[t] = o + down * x, np.exp(e[t]) * (up * o + stay * x)
        for t in range(n - 1, 0, -1):
            o, x = back[t] / back[t].sum()
            back[t - 1] = o + up * np.exp(e[t]) * x, down * o + stay * np.exp(e[t]) * x
        both = forward * back
        chains = toxicity.Chains([e[:1], e], start, moves)
        assert chains.of_chains(chains.marginals())[1] == pytest.approx(both[:, 1] / both.sum(axis=1))


def test_offsets_are_those_of_the_text(spark):
    model = toxicity.TaggerModel(np.zeros(1 << toxicity.BITS, np.float32), -3.0, np.array([-3.0, 0.0, 0.0]), -3.0, (-6.0, 1.0, 0.0))
    for w in ("badword",):
        model.weights[toxicity.feature_ids(w)[0]] = 30.0
    df = spark.createDataFrame([(1, "İİİ badword x BADWORD badword"), (2, None), (3, "ok " * 5000 + "badword")], "doc_id long, text string").withColumn("score", F.lit(9))
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert out[1]["toxic_spans"] == "4:11,14:29" and out[2]["toxic_spans"] == "" and out[3]["toxic_spans"] == "15000:15007"
    assert out[1]["score"] == 9 and out[1]["score_"] > 0.5 and out[1]["predicted"] == 1


def test_rejected_rows_go(spark, awkward):
    model = toxicity.TaggerModel(np.zeros(1 << toxicity.BITS, np.float32), -3.0, np.array([-3.0, 0.0, 0.0]), -3.0, (-6.0, 1.0, 0.0))
    model.weights[toxicity.feature_ids("here")[0]] = 30.0
    kept = toxicity.reject_toxic(awkward, model)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t, _ in ROWS if "here" not in (t or "").lower())
    assert toxicity.reject_toxic(awkward.limit(0), model).count() == 0


def test_language(spark, awkward):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    held = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if r["lang"] and found[r["doc_id"]]["held_out"]]
    assert np.mean(held) >= 0.95
    out = {r["doc_id"]: r for r in langid.language_id(awkward).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == "und" and len(out) == 8
    assert langid.language_id(awkward.limit(0)).count() == 0


def test_mixing_meets_targets(spark, awkward):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = mixing.fit_domains(docs, labels)
    rows = mixing.with_posteriors(docs.select("doc_id", "text"), model, "tokens", "posterior").select("tokens", "posterior").persist()
    fit = mixing.fit_rates(rows, model.domains, mixing.tempered(0.5, grow=False))
    p = np.array([r["posterior"] for r in rows.collect()])
    t = np.array([r["tokens"] for r in rows.collect()])
    rates = fit.rates(p)
    assert (rates >= 0).all()
    assert (t * rates) @ p == pytest.approx(fit.targets, rel=0.05)
    assert mixing.mixing_rates(awkward, labels_of(spark)).count() == len(ROWS)
    mixed = mixing.mix_documents(awkward, labels_of(spark))
    assert mixed.columns == awkward.columns and mixed.select("text").distinct().count() == len({t for _, t, _ in ROWS})
    assert mixing.mixing_rates(awkward.limit(0), labels_of(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    toxic, exact, near, mixed, packed = seen[1:]
    fold = lambda df: df.select(F.lower("text")).distinct().count()
    assert docs.count() >= toxic.count() >= exact.count() >= near.count() and exact.count() >= fold(exact)
    ids = {r[0] for r in near.select("doc_id").collect()}
    assert {r[0] for r in mixed.select("doc_id").collect()} == ids == {r[0] for r in packed.select("doc_id").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(exact).collect()}
    assert sorted(classes[i] for i in ids) == sorted(set(classes.values()))


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))


def test_added_kinds_and_postings_brute(spark):
    draw = __import__("random").Random(4)
    kinds = {"private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "forge_token": r"gh[pousr]_[A-Za-z0-9]{36,}", "chat_token": r"xox[abprs]-[A-Za-z0-9-]{10,}"}
    bits = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----begin private key-----", "ghp_" + "aB3" * 13, "ghx_" + "a" * 40, "gho_" + "z" * 35, "xoxb-" + "1a-" * 5, "xoxz-123456789012", " ", "\U0001f600", "x"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 6)))) for i in range(200)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit(1)).withColumn("found", F.lit("x"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"] if s["kind"] in kinds] for r in secret_scan.scan_secrets(df).collect()}
    for i, text in rows:
        want = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text or ""))
        assert got[i] == [(k, a, b) for a, _, k, b in want]
    terms = secret_scan.terms_of(secret_scan.BASE_RULES + secret_scan.MORE_RULES)[1]
    posted = sorted((r["term"], r["doc_id"]) for r in secret_scan.postings(df).collect())
    assert posted == sorted((t, i) for i, text in rows if text for t in terms if t in text.lower())
    # an id is asked by a rule when it is in the postings of all trigrams of a clause of it; repeats add up
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    more = df.unionByName(df.filter("doc_id % 3 = 0").withColumn("text", F.reverse("text")))
    held = {}
    for r in more.collect():
        held.setdefault(r["doc_id"], set()).update(t for t in terms if t in (r["text"] or "").lower())
    asked = {i: {n for n, clauses in secret_scan.terms_of(rules)[0].items() if any(set(c) <= h for c in clauses)} for i, h in held.items() if i is not None}
    met = {r["asked_id"]: set(r["asked"]) for r in secret_scan.candidates(secret_scan.postings(more), rules).collect()}
    assert met == {i: a for i, a in asked.items() if a} and 0 < len(met) < len(held)
    # beyond the bound of a broadcast, the rows are the same
    every = lambda most: sorted((r["doc_id"] or -1, str(r["found"])) for r in secret_scan.scan_secrets(more, most_broadcast=most).collect())
    assert every(0) == every(1 << 19) and len(every(0)) == more.count()


def test_rates_against_least_squares():
    """Rates meet targets that nonnegative rates can meet, and stay near 1 where targets leave them free."""
    draw = np.random.default_rng(2)
    p, t = draw.dirichlet(np.ones(3), 400), draw.integers(1, 50, 400).astype(float)
    a = p.T * t  # domains x rows
    want = a @ draw.uniform(0.2, 2.0, 400)
    r = np.ones(400)  # plain projected gradient, to the end
    for _ in range(20_000):
        r = np.maximum(0.0, r - (a.T @ ((a @ r - want) / want**2)) / np.linalg.norm(a / want[:, None], 2) ** 2)
    fit = mixing.RateFit(["a", "b", "c"], a.sum(axis=1), want, 1.0 / (1.0 + mixing.ANCHOR), 0.0, [])
    for _ in range(60):
        fit.gaps.append((a @ fit.replay(p)[1] - want) / a.sum(axis=1))
    assert (fit.rates(p) >= 0).all() and a @ fit.rates(p) == pytest.approx(want, rel=1e-3) and a @ r == pytest.approx(want, rel=1e-3)
    # replays from a written state go on as replays from the start do
    state = mixing.RateFit(fit.domains, fit.available, want, fit.step, 0.0, fit.gaps[:25]).replay(p)
    assert fit.replay(p, 25, state)[0] == pytest.approx(fit.rates(p))


def test_ids_that_repeat_keep_their_texts_apart(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:59] + ["other"]), " ".join(reversed(words))
    df = spark.createDataFrame([(3, a), (5, b), (5, c), (7, None), (None, a), (9, c + " tail")], "doc_id long, text string").withColumn("gone", F.lit("x")).withColumn("text_key", F.lit(1))
    kept = near_dup.keep_one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted([("3", a), ("5", c), ("None", a)]) and kept.filter("text is null").count() == 1


def test_buckets_hold_equal_lengths(spark, tmp_path):
    import public_tokenizers

    from kerbside.llm import packing

    df = spark.createDataFrame([(i, "word " * (37 * i)) for i in range(6)], "doc_id long, text string")
    packing.write_buckets(packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")), f"{tmp_path}/b")
    rows = spark.read.parquet(f"{tmp_path}/b").select("bucket", "length").distinct().collect()
    assert rows and all(1 << r["bucket"] == r["length"] for r in rows)
