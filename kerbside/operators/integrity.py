"""Text integrity: spam signals, gibberish, text reuse, likeness of vectors, verdicts."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from ..functions.geo import half_up, haversine_km
from ..functions.letters import KEY_TRIPLES, LETTERS, shares_of_letters
from ..plans.bindings import spread
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query
from ..plans.steps import checkpoint
from .spatial import radius_pairs
from .vectors import asked, cosine_pairs, doubles

c = F.col
#: Words of advertising, and words that a report of an accident has.
PROMO = r"\b(buy|discount|offer|sale|cheap|click|subscribe|whats\s?app|telegram|loan|crypto|bitcoin|casino|betting|earn money|work from home|free gift|follow me|dm me|promo|coupon|investment|lottery|win cash|visit (our|my) (site|page))\b"
ACCIDENT = r"accident|collid|collision|crash|hit\b|hit by|knock|overturn|skid|injur|dead|died|death|killed|bike|motorcycl|scooter|car\b|cab\b|bus\b|bmtc|ksrtc|truck|lorry|tipper|tanker|auto\b|autorickshaw|pedestrian|two[- ]wheeler|vehicle|rammed|run over|fell|flyover|junction|signal|ambulance|hospital|pothole|rider|driver|helmet|highway|road"
#: Links, telephone numbers and e-mail addresses.
LINK = r"(?i)https?://|www\.|\.(com|in|net|xyz|ly)\b"
CONTACT = r"(\+91[\s-]?)?\b[6-9]\d{9}\b|[\w.+-]+@[\w-]+\.[\w.]+"
PHONE, EMAIL = r"\b[6-9]\d{9}\b", r"[\w.+-]+@[\w-]+\.[\w.]+"

#: Weights of the signals, and what makes a text gibberish.
WEIGHTS = {"link": 0.35, "contact_info": 0.2, "promotional": 0.35, "shouting": 0.1, "repeated_chars": 0.1, "low_text_ratio": 0.15, "repetitive": 0.15, "gibberish": 0.65}
MASH, RARE, LEARNT, SEEN = 0.35, 0.12, 2000, 3
OFF_TOPIC, FLOOD, HASTE = 0.35, (8, 0.35), (4, 0.2)
ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def signals(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text) with a flag for each sign of spam; ``pairs`` is one row, the letter pairs that
    titles know (null: too few titles to tell). Texts are folded once; costly patterns run only
    where a plain search finds what they need."""
    text, low = F.coalesce("text", F.lit("")), c("low")
    rows = df.crossJoin(F.broadcast(pairs)).select(*df.columns, shares_of_letters(text, c("pairs")).alias("letters"), text.alias("whole"), F.lower(text).alias("low"))
    rows = rows.withColumn("words", F.split(F.trim(F.regexp_replace(low, "[^a-z\u0c80-\u0cff\u0900-\u097f]+", " ")), " "))
    caps = without(c("whole"), ASCII)
    letters = without(c("whole"), ASCII + ASCII.lower())
    packed = F.length(F.regexp_replace("whole", r"\s+", ""))
    other = F.length(F.regexp_replace("whole", r"[\s\p{L}]+", ""))
    flags = {
        "link": (low.contains("://") | low.contains(".")) & low.rlike(LINK),
        "contact_info": (low.contains("@") & c("whole").rlike(EMAIL)) | c("whole").rlike(PHONE),
        "promotional": low.rlike(PROMO),
        "shouting": (letters > 20) & (caps * 2 > letters),
        "repeated_chars": c("whole").rlike(r"(.)\1{5,}"),
        "low_text_ratio": (packed > 15) & ((packed - other) * 10 < packed * 6),
        "repetitive": (F.size("words") >= 10) & (F.size(F.array_distinct("words")) * 100 < F.size("words") * 35),
        "gibberish": (c("letters.mash") >= MASH) | F.coalesce(c("letters.rare") >= RARE, F.lit(False)),
    }
    return rows.select(*[x for x in df.columns if x != "text"], *[f.alias(k) for k, f in flags.items()])


RUNS = "len(list_filter(list_distinct(string_split(text, '')), lambda ch: ch <> chr(10) and ch <> chr(13) and contains(text, repeat(ch, 6)))) > 0"
MASHED = f"""mw as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')) as w from documents),
    mr as (select doc_id, sum(length(w)) as letters, sum(length(w) - 2) as triples, sum(list_sum(list_transform(regexp_extract_all(w, '[^aeiouy]{{5,}}'), lambda x: length(x)))) as runs,
        sum(len(list_filter(range(1, length(w) - 1), lambda i: substr(w, i, 3) in ({", ".join(f"'{x}'" for x in KEY_TRIPLES)})))) as keys from mw group by 1),
    mash as (select doc_id, case when letters < 12 then 0e0 else greatest(coalesce(runs, 0) / cast(letters as double), keys / cast(triples as double) * 1.5e0) end as g from mr)"""
BIGRAMS = "(select {key}, unnest(list_transform(range(1, length(w) + 2), lambda i: substr('^' || w || '$', i, 2))) as pair from (select {key}, unnest(regexp_extract_all(lower({text}), '[a-z]{{2,}}')) as w from {rel}))"
TITLES = BIGRAMS.replace("{key}", "id").replace("{text}", "concat_ws(' ', title, location, area)").replace("{rel}", "active").replace("{{2,}}", "{2,}")
DOCS = BIGRAMS.replace("{key}", "doc_id").replace("{text}", "coalesce(text, '')").replace("{rel}", "documents").replace("{{2,}}", "{2,}")
ODD = f"""tp as (select pair, count(*) as n from {TITLES} group by 1), known as (select pair from tp where n >= {SEEN} and (select sum(n) from tp) >= {LEARNT}),
    odd as (select doc_id, count(*) filter (where known.pair is null) / cast(count(*) as double) as rare from {DOCS} d left join known using (pair) where (select sum(n) from tp) >= {LEARNT} group by 1 having count(*) >= {LETTERS})"""
SIGNALS = f"""{MASHED}, {ODD}, s as (select doc_id, coalesce(text, '') as text, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) as caps,
        length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) as packed, regexp_extract_all(lower(coalesce(text, '')), '[a-z\u0c80-\u0cff\u0900-\u097f]+') as words from documents),
    g as (select s.doc_id, regexp_matches(text, '{LINK}') as link, regexp_matches(text, '{CONTACT}') as contact_info, regexp_matches(text, '(?i){PROMO}') as promotional, letters > 20 and caps * 2 > letters as shouting,
        {RUNS} as repeated_chars, packed > 15 and length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) * 10 < packed * 6 as low_text_ratio,
        len(words) >= 10 and len(list_distinct(words)) * 100 < len(words) * 35 as repetitive, coalesce(g >= {MASH}, false) or coalesce(rare >= {RARE}, false) as gibberish
        from s left join mash on mash.doc_id = s.doc_id left join odd on odd.doc_id = s.doc_id)"""


@query(f"with {SIGNALS} select * from g")
def spam_signals(t):
    return signals(t.documents.select("doc_id", "text"), known_pairs(t))


def noisy_or_of(weights: Column) -> Column:
    """1 - product of (1 - w)."""
    return F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (F.lit(1.0) - w))


NOISY = " * ".join(f"(1e0 - case when {k} then {w}e0 else 0e0 end)" for k, w in WEIGHTS.items())
SPAM = sql_half_up(f"1e0 - {NOISY}", 2)


def weights_of(signals: dict[str, float]) -> Column:
    return F.array(*[F.when(c(k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in signals.items()])


def spam_scores(t) -> DataFrame:
    found = signals(t.documents.select("doc_id", "text"), known_pairs(t))
    return found.select("doc_id", half_up(noisy_or_of(weights_of(WEIGHTS)), 2).alias("spam_score"))


@query(f"with {SIGNALS} select doc_id, {SPAM} as spam_score from g")
def noisy_or(t):
    return spam_scores(t)


VERDICT = "case when spam_score >= 0.6 then 'likely_spam' when spam_score >= 0.3 then 'review' else 'ok' end"


@query(f"with {SIGNALS} select doc_id, {VERDICT} as verdict from (select doc_id, {SPAM} as spam_score from g)")
def integrity_verdict(t):
    s = c("spam_score")
    return spam_scores(t).select("doc_id", F.when(s >= 0.6, "likely_spam").when(s >= 0.3, "review").otherwise("ok").alias("verdict"))


@query(f"select doc_id, not regexp_matches(coalesce(text, ''), '(?i){ACCIDENT}') as off_topic from documents")
def off_topic(t):
    return t.documents.select("doc_id", (~F.coalesce("text", F.lit("")).rlike("(?i)" + ACCIDENT)).alias("off_topic"))


@query(f"with {MASHED} select d.doc_id, coalesce({sql_half_up('g', 3)}, 0e0) as score from documents d left join mash on mash.doc_id = d.doc_id")
def gibberish_score(t):
    return letter_scores(t).select("doc_id", half_up(c("x.mash"), 3).alias("score"))


def letter_scores(t) -> DataFrame:
    d = t.documents.crossJoin(F.broadcast(known_pairs(t)))
    return d.select("doc_id", shares_of_letters(F.coalesce("text", F.lit("")), c("pairs")).alias("x"))


def title_pairs(t) -> DataFrame:
    """(pair, n): letter pairs of the words of titles and places, with each word's start ^ and end $."""
    words = F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "location", "area")), F.lit("[a-z]{2,}"), F.lit(0)))
    counted = t.active.select(words.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))  # words repeat, so pairs are made once for each
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, 2))
    return counted.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def known_pairs(t) -> DataFrame:
    """One row, ``pairs``: the letter pairs that titles have three times or more, joined; null if they
    have fewer than 2000 pairs in all. There are at most 27 x 27 pairs."""
    known = F.array_join(F.array_sort(F.collect_list(F.when(c("n") >= SEEN, c("pair")))), "")
    return title_pairs(t).agg(F.when(F.sum("n") >= LEARNT, known).alias("pairs"))


@query(f"select pair, count(*) as n from {TITLES} group by 1")
def bigram_model(t):
    return title_pairs(t)


@query(f"with {ODD} select doc_id, {sql_half_up('rare', 3)} as rare from odd")
def rare_bigram_fraction(t):
    """Share of a text's letter pairs that are rare in the titles."""
    return letter_scores(t).select("doc_id", half_up(c("x.rare"), 3).alias("rare")).filter("rare is not null")


# --- likeness --------------------------------------------------------------------------

DOT = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[]))"
NORM = "sqrt(list_dot_product(cast({0}.embedding as double[]), cast({0}.embedding as double[])))"
COSINE = f"round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 12)"


@query(f"""
    with x as (select a.vec_id as query_id, b.vec_id, {COSINE} as s from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
    select query_id, vec_id, {sql_half_up('s', 4)} + 0e0 as similarity from x qualify row_number() over (partition by query_id order by s desc, vec_id) <= 5""")
def cosine_topk(t):
    """Five most similar vectors of each query (ids that 50 divides): best of shards, then of all."""
    from pyspark.sql import Window

    v = doubles(t.embeddings, "vec_id", "embedding")
    x = cosine_pairs(v.filter(asked(v)), v, most=5)
    best = x.withColumn("r", F.row_number().over(Window.partitionBy("a_id").orderBy(c("s").desc(), "b_id"))).filter("r <= 5")
    return best.select(c("a_id").alias("query_id"), c("b_id").alias("vec_id"), (half_up(c("s"), 4) + F.lit(0.0)).alias("similarity"))


#: Slots of a hashed vector, its alphabet, and the weights of words and of character triples.
SLOTS, OTHER, WORD_WEIGHT, TRIPLE_WEIGHT = 1024, "[^a-z0-9\u0c80-\u0cff\u0900-\u097f ]+", 1.0, 0.5
#: From which likeness texts of hashed vectors are reused.
REUSED = 0.9
#: Tokens whose slots a task remembers; it sets the speed only.
CACHED_TOKENS = 200_000


def folded_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "), " +", " "))


class TokenSlots(dict):
    """Token to its slot and sign: the digest's first four bytes as a little-endian number, and the
    lowest bit of the fifth."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        h = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
        self[token] = found = int.from_bytes(h[:4], "little") % SLOTS, 1 if h[4] & 1 else -1
        return found


def with_vectors(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``v``, the hashed vector of each whole text, instead of the text: SLOTS signed counts of
    words of three letters or more and of character triples. Nothing is shuffled: a text becomes
    its vector where it is read, in a stream too. Null and empty texts have only zeros."""

    def hashed(batches):
        slots = TokenSlots()
        for batch in batches:
            texts, out = batch.column(len(names)), []
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                v = np.zeros((len(part), SLOTS), np.float32)
                for n, s in enumerate(part):
                    padded = f" {s} "
                    for w, times in Counter(s.split(" ")).items():
                        if len(w) > 2:
                            slot, sign = slots["w:" + w]
                            v[n, slot] += sign * times * WORD_WEIGHT
                    for x, times in Counter(map("".join, zip(padded, padded[1:], padded[2:]))).items():
                        slot, sign = slots["c:" + x]
                        v[n, slot] += sign * times * TRIPLE_WEIGHT
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, SLOTS), pa.int32()), pa.array(v.ravel())))
            vectors = pa.chunked_array(out).combine_chunks() if out else pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*names, "v"])

    names = [x for x in df.columns if x != text]
    rows = df.select(*names, folded_text(c(text)).alias("s"))
    return rows.mapInArrow(hashed, StructType([*rows.schema.fields[:-1], StructField("v", ArrayType(FloatType()))]))


def text_vectors(df: DataFrame, key: str) -> DataFrame:
    """(id, v) of the texts of ``df``."""
    return with_vectors(df.select(c(key).cast("long").alias("id"), "text"), "text")


def token_sql(table: str, key: str) -> str:
    """Slots and weights of all texts of a table, tokens being counted and hashed once each."""
    return f"""
    ts as (select {key} as id, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{OTHER}', ' ', 'g'), ' +', ' ', 'g')) || ' ' as s from {table}),
    tk as (select id, token, sum(each) as each from (select id, 'w:' || w as token, 1e0 as each from (select id, unnest(string_split(trim(s), ' ')) as w from ts) where length(w) > 2
        union all select id, 'c:' || x, 0.5e0 from (select id, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as x from ts)) group by 1, 2),
    th as (select token, md5(token) as h from (select distinct token from tk)),
    tw as (select id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint % 1024 as slot, sum(case when ('0x' || substr(h, 10, 1))::bigint % 2 = 1 then each else -each end) as weight from tk join th using (token) group by 1, 2 having weight <> 0)"""


VECTORS = f"""{token_sql('documents', 'doc_id')},
    nm as (select id, sqrt(sum(weight * weight)) as norm from tw group by 1),
    cs as (select a.id as a_id, b.id as b_id, round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 12) as s from tw a join tw b on a.slot = b.slot and a.id % 50 = 0 and a.id <> b.id join nm na on na.id = a.id join nm nb on nb.id = b.id group by 1, 2),
    p as (select d.doc_id as id, i.lat, i.lng, i.accident_date from documents d join active i on i.seq = d.doc_id)"""


def placed(t) -> DataFrame:
    """Reports with a text: a document is the description of the incident of its number."""
    return t.active.select(c("seq").alias("id"), "lat", "lng", "accident_date").join(t.documents.select(c("doc_id").alias("id")), "id", "left_semi")


def far_apart(metres: float = 2000.0, days: int = 2) -> Column:
    """Over so many metres apart, or, where both are dated, over so many days."""
    m = haversine_km(c("a_lat"), c("a_lng"), c("b_lat"), c("b_lng")) * 1000.0
    return (m > metres) | F.coalesce(F.abs(F.datediff("a_accident_date", "b_accident_date")) > days, F.lit(False))


def reused(vectors: DataFrame, places: DataFrame, least: float = REUSED) -> DataFrame:
    """Pairs of a query (id that 50 divides) and another report with nearly the same text, filed for another
    place or date. Of hashed vectors the usual bounds by shared slots cut nothing: a text fills
    four of ten slots, so queries meet all rows in blocks."""
    placed_only = vectors.join(places.select("id"), "id", "left_semi")
    pairs = cosine_pairs(placed_only.filter(asked(vectors)), placed_only, least)
    at = lambda x: places.select(*[c(k).alias(f"{x}_{k}") for k in ("id", "lat", "lng", "accident_date")])
    return pairs.join(at("a"), "a_id").join(at("b"), "b_id").filter(far_apart()).select("a_id", "b_id", half_up(c("s"), 4).alias("similarity"))


FAR = f"({km('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1000e0 > 2000e0 or coalesce(abs(date_diff('day', a.accident_date, b.accident_date)) > 2, false))"


@query(f"with {VECTORS} select a_id, b_id, {sql_half_up('s', 4)} as similarity from cs join p a on a.id = a_id join p b on b.id = b_id where s >= {REUSED}e0 and {FAR}")
def text_reuse_pairs(t):
    """Reports whose whole texts are alike by hashed vectors, at 0.9, filed for another place or date."""
    return reused(text_vectors(t.documents, "doc_id"), placed(t))


#: Fixed value: photos are alike up to so many bits of 64.
ALIKE_BITS = 6
DIGITS = "('0x' || substr(md5({0}), {1}, 8))::bigint"
TURNED = DIGITS.format("event_id::varchar || ':turned'", 1) + " % 9"
PLACE = lambda k: DIGITS.format(f"event_id::varchar || ':{k}'", 1) + " % 64"
HASHES = "h as (select event_id as id, {} as hi, {} as lo from events)".format(
    *[
        "xor(" * 8 + DIGITS.format("(event_id // 4)::varchar", start) + "".join(f", case when {TURNED} > {k} and {PLACE(k)} between {low} and {low + 31} then 1::bigint << ({PLACE(k)} - {low})::int else 0 end)" for k in range(8))
        for start, low in ((1, 32), (9, 0))
    ]
)
CLASSES = "r as (select hi, lo, min(id) as rep_id, count(*) as members from h group by 1, 2)"


def photo_hashes(t) -> DataFrame:
    """(id, hash): a 64-bit hash of the photo of every event. Four events in a row have versions
    of one photo; each version has up to eight bits of the photo's hash turned."""
    digest = lambda *x: F.md5(F.concat(*x).cast("binary"))
    number = lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long")
    event = c("event_id").cast("string")
    turned = number(digest(event, F.lit(":turned"))) % 9
    h = F.conv(F.substring(digest(F.floor(c("event_id") / 4).cast("string")), 1, 16), 16, -10).cast("long")
    rows = spread(t.events.select("event_id")).select("event_id", turned.alias("turned"), h.alias("hash"), *[(number(digest(event, F.lit(f":{k}"))) % 64).cast("int").alias(f"p{k}") for k in range(8)])
    out = c("hash")
    for k in range(8):
        out = out.bitwiseXOR(F.when(c("turned") > k, F.expr(f"shiftleft(1L, p{k})")).otherwise(F.lit(0).cast("long")))
    return rows.select(c("event_id").alias("id"), out.alias("hash"))


def hash_classes(df: DataFrame) -> DataFrame:
    """(rep_id, hash, members) of (id, hash): equal hashes have the least id as representative.
    Rows without a hash have no photo."""
    return df.filter(c("hash").isNotNull()).groupBy("hash").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("members"))


def bands_for(n: int) -> int:
    """How many bands to cut 64 bits into: six bits touch six bands at most, so all but six are equal. More
    bands make more and longer keys; the number with the least rows and even candidates is taken."""
    work = lambda m: math.comb(m, ALIKE_BITS) * (n + n * n / 2.0 ** (64 * (m - ALIKE_BITS) / m + 1))
    return min(range(ALIKE_BITS + 2, 13), key=work)


def near_hashes(df: DataFrame, bands: int | None = None) -> DataFrame:
    """Pairs of representatives whose hashes differ in one to six bits.

    Hashes meet by each choice of the bands that six differing bits leave equal (pigeonhole),
    and are tested exactly. A pair that shares several choices comes out at the first one only, so
    nothing is made distinct afterwards. Choices get longer as the hashes get more (``bands_for``).
    Any choice has one of the first seven bands, so a row is dealt out seven times, by the value of
    each of these, and the other bands of a choice are held against each other where the rows are.
    """
    classes = checkpoint(hash_classes(df).select("rep_id", "hash"))
    m = bands or bands_for(classes.count())
    edges = [64 * k // m for k in range(m + 1)]
    need = m - ALIKE_BITS
    masks = [((1 << hi - lo) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    kind = classes.schema["rep_id"].dataType

    def met(key: tuple, rows: pa.Table) -> pa.Table:
        first = key[0].as_py()
        ids, h = rows.column("rep_id").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
        found: list[tuple] = []
        for rest in combinations(range(first + 1, m), need - 1):
            some = (first, *rest)
            cut = h & np.uint64(sum(masks[k] for k in some))
            order = np.argsort(cut)
            cut, at = cut[order], h[order]
            gap, left = 1, np.arange(len(cut) - 1)
            # what is equal to the row so many places on is equal to all rows between
            while len(left := left[cut[left] == cut[left + gap]]):
                apart = at[left] ^ at[left + gap]
                bits = np.bitwise_count(apart)
                near = bits <= ALIKE_BITS
                # of the bands between those of the choice none may be equal, or another choice has the pair
                for k in range(some[-1]):
                    if k not in some:
                        near &= (apart & np.uint64(masks[k])) != 0
                a, b = ids[order[left[near]]], ids[order[left[near] + gap]]
                found.append((np.minimum(a, b), np.maximum(a, b), bits[near].astype(np.int32)))
                gap += 1
                left = left[left + gap < len(cut)]
        columns = [np.concatenate(x) for x in zip(*found)] if found else [ids[:0], ids[:0], np.zeros(0, np.int32)]
        return pa.table([pa.array(x, rows.schema.field("rep_id").type if n < 2 else pa.int32()) for n, x in enumerate(columns)], names=["a_id", "b_id", "distance"])

    value = [F.shiftrightunsigned("hash", lo).bitwiseAND((1 << hi - lo) - 1) for lo, hi in zip(edges, edges[1:])][: ALIKE_BITS + 1]
    dealt = classes.select("rep_id", "hash", F.posexplode(F.array(*value)).alias("band", "value"))
    # a row is few bytes and much work, so partitions are not put together by their bytes
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "value")
    return dealt.groupBy("band", "value").applyInArrow(met, StructType([StructField("a_id", kind), StructField("b_id", kind), StructField("distance", IntegerType())]))


@query(f"with {HASHES}, {CLASSES} select h.id as event_id, r.rep_id, r.members from h join r on h.hi = r.hi and h.lo = r.lo")
def photo_hash_classes(t):
    """Membership of every photo: pairs of equal hashes, without a row for each pair."""
    h = photo_hashes(t)
    return h.join(hash_classes(h), "hash").select(c("id").alias("event_id"), "rep_id", "members")


@query(f"""
    with {HASHES}, {CLASSES} select a.rep_id as a_id, b.rep_id as b_id, cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as int) as distance from r a join r b on a.rep_id < b.rep_id
    where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {ALIKE_BITS}""")
def hamming_pairs(t):
    """Near matches of all photos, between the representatives of equal hashes."""
    return near_hashes(photo_hashes(t))


#: Shares of text, place and date in a duplicate's score, its reach, and its verdicts.
SHARES, REACH_M, REACH_DAYS, LIKELY, POSSIBLE, LIKELY_M = (0.55, 0.3, 0.15), 1500.0, 2, 0.7, 0.45, 500.0


def duplicates(vectors: DataFrame, places: DataFrame, low: float = 0.1, span: float = 0.7, possible: float = POSSIBLE) -> DataFrame:
    """Likeness of text, place and date in one score, for reports (ids that 50 divides) and
    all others within 1500 m and, where both are dated, two days. Candidates meet by place; only their
    vectors are compared. ``low`` and ``span`` bring likeness to a scale from 0 to 1: those of
    hashed vectors, unless others are given."""
    at = lambda x, df: df.select(*[c(k).alias(f"{x}_{k}") for k in ("id", "lat", "lng", "accident_date")])
    pairs = radius_pairs(at("a", places.filter(asked(places))), at("b", places), REACH_M).filter("a_id != b_id")
    days = F.abs(F.datediff("a_accident_date", "b_accident_date"))
    pairs = pairs.withColumn("days", days).filter(c("days").isNull() | (c("days") <= REACH_DAYS))
    v = lambda x: vectors.select(c("id").alias(f"{x}_id"), c("v").alias(f"{x}_v"))
    met = pairs.select("a_id", "b_id", "m", "days").join(v("a"), "a_id").join(v("b"), "b_id")
    return scored_duplicates(cosines(met, ["a_id", "b_id", "m", "days"]), low, span, possible)


def scored_duplicates(pairs: DataFrame, low: float = 0.1, span: float = 0.7, possible: float = POSSIBLE) -> DataFrame:
    """Scores and verdicts of (a_id, b_id, m, days, s)."""
    alike = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("s") - low) / span))
    when = F.when(c("days").isNull(), 0.3).when(c("days") == 0, 1.0).when(c("days") <= 1, 0.7).otherwise(0.4)
    score = F.lit(SHARES[0]) * alike + F.lit(SHARES[1]) * F.greatest(F.lit(0.0), F.lit(1.0) - c("m") / REACH_M) + F.lit(SHARES[2]) * when
    y = pairs.select("a_id", "b_id", half_up(c("m")).alias("metres"), half_up(score, 2).alias("score")).filter(c("score") >= possible)
    return y.select("a_id", "b_id", "score", F.when((c("score") >= LIKELY) & (c("metres") <= LIKELY_M), "likely_duplicate").otherwise("possible_duplicate").alias("verdict"))


def cosines(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of pairs with a_v and b_v, and ``s``, the cosine of these (0 if one has no length)."""

    def multiply(batches):
        for batch in batches:
            a, b = (batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for x in ("a_v", "b_v"))
            norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
            s = np.round(np.divide((a * b).sum(axis=1), norms, out=np.zeros(len(a)), where=norms > 0), 12)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(s)], [*names, "s"])

    rows = pairs.select(*names, "a_v", "b_v")
    return rows.mapInArrow(multiply, StructType([*rows.schema.fields[: len(names)], StructField("s", DoubleType())]))


SCORED = f"""x as (select a.id as a_id, b.id as b_id, coalesce(s, 0e0) as s, abs(date_diff('day', a.accident_date, b.accident_date)) as days, {km('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1000e0 as m
        from p a join p b on a.id % 50 = 0 and a.id <> b.id left join cs on cs.a_id = a.id and cs.b_id = b.id),
    y as (select *, {sql_half_up("0.55e0 * greatest(0e0, least(1e0, (s - 0.1e0) / 0.7e0)) + 0.3e0 * greatest(0e0, 1e0 - m / 1500e0) + 0.15e0 * case when days is null then 0.3e0 when days = 0 then 1e0 when days <= 1 then 0.7e0 else 0.4e0 end", 2)} as score from x where m <= 1500 and coalesce(days <= 2, true)),
    du as (select a_id, b_id, score, case when score >= {LIKELY} and {sql_half_up('m')} <= {LIKELY_M} then 'likely_duplicate' else 'possible_duplicate' end as verdict from y where score >= {POSSIBLE})"""


@query(f"with {VECTORS}, {SCORED} select * from du")
def duplicate_score(t):
    """Possible and likely duplicates among reports, by whole texts, places and dates."""
    return duplicates(text_vectors(t.documents, "doc_id"), placed(t))


def hashed_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, slot, weight): signed counts of words of three letters or more and of character triples
    in 1024 hashed slots, as sparse rows. Tokens are counted before they are hashed."""
    folded = folded_text(c("text"))
    rows = df.select(key, F.concat(F.lit(" "), folded, F.lit(" ")).alias("s"))
    words = F.transform(F.filter(F.split(F.trim("s"), " "), lambda w: F.length(w) > 2), lambda w: F.concat(F.lit("w:"), w))
    triples = F.transform(F.regexp_extract_all("s", F.lit("(?=(...))"), F.lit(1)), lambda x: F.concat(F.lit("c:"), x))
    counted = rows.select(key, F.explode(F.concat(words, triples)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    h = F.md5(c("token").cast("binary"))
    # the digest's first four bytes as a little-endian number, and the lowest bit of its fifth
    number = F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    each = F.when(c("token").startswith("w:"), WORD_WEIGHT).otherwise(TRIPLE_WEIGHT)
    slots = counted.select(key, (number % SLOTS).alias("slot"), (sign * each * c("n")).alias("w"))
    return slots.groupBy(key, "slot").agg(F.sum("w").alias("weight")).filter("weight != 0")


@query(f"with {token_sql('benchmark', 'item_id')} select * from tw")
def hashed_tf(t):
    return hashed_vectors(t.benchmark.select(c("item_id").alias("id"), "text"), "id")


REPORTS = f"""{SIGNALS}, v as (select event_id, count(*) over (partition by user_id order by epoch(ts) range between 86400 preceding and current row) as recent from events),
    rp as (select g.*, not regexp_matches(coalesce(d.text, ''), '(?i){ACCIDENT}') as off_topic, coalesce(v.recent, 0) >= 8 as flood, coalesce(v.recent, 0) between 4 and 7 as haste from g join documents d on d.doc_id = g.doc_id left join v on v.event_id = g.doc_id)"""
REPORTED = {**WEIGHTS, "off_topic": OFF_TOPIC, "flood": FLOOD[1], "haste": HASTE[1]}
REPORT_SCORE = sql_half_up("1e0 - " + " * ".join(f"(1e0 - case when {k} then {w}e0 else 0e0 end)" for k, w in REPORTED.items()), 2)


def report_flags(t) -> DataFrame:
    """Documents with their signs of spam, whether they are off topic, and their reporter's haste."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86400_000_000, 0)
    recent = t.events.select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("at")).select("event_id", F.count(F.lit(1)).over(w).alias("recent"))
    text = F.coalesce("text", F.lit(""))
    d = t.documents.select("doc_id", "text", (~text.rlike("(?i)" + ACCIDENT)).alias("off_topic"))
    rows = signals(d, known_pairs(t)).join(recent, c("doc_id") == c("event_id"), "left")
    n = F.coalesce("recent", F.lit(0))
    return rows.withColumns({"flood": n >= FLOOD[0], "haste": (n >= HASTE[0]) & (n < FLOOD[0])})


@query(f"""
    with {REPORTS}, sc as (select doc_id, {REPORT_SCORE} as spam_score, concat_ws(',', {", ".join(f"case when {k} then '{k}' end" for k in REPORTED)}) as signals from rp)
    select doc_id, spam_score, signals, {VERDICT} as verdict from sc""")
def integrity_report(t):
    """Signals of the text, its topic and its reporter's haste in one score and verdict. A report
    is a document, filed as the event of its number; the last day's reports of that user count."""
    rows = report_flags(t)
    score = half_up(noisy_or_of(weights_of(REPORTED)), 2)
    s = rows.select("doc_id", score.alias("spam_score"), F.concat_ws(",", *[F.when(c(k), k) for k in REPORTED]).alias("signals"))
    return s.select("doc_id", "spam_score", "signals", F.when(c("spam_score") >= 0.6, "likely_spam").when(c("spam_score") >= 0.3, "review").otherwise("ok").alias("verdict"))


REUSE_WEIGHT = 0.3


@query(f"""
    with {REPORTS}, {VECTORS}, {SCORED}, ru as (select a_id, count(*) as reused from cs join p a on a.id = a_id join p b on b.id = b_id where s >= {REUSED}e0 and {FAR} group by 1),
    be as (select a_id, arg_max(b_id, (score, -b_id)) as duplicate_of, max(score) as duplicate_score, arg_max(verdict, (score, -b_id)) as duplicate_verdict from du group by 1),
    z as (select *, 1e0 - {" * ".join(f"(1e0 - case when {k} then {w}e0 else 0e0 end)" for k, w in REPORTED.items())} * (1e0 - case when reused > 0 then {REUSE_WEIGHT}e0 else 0e0 end) as raw from p join rp on rp.doc_id = p.id left join ru on ru.a_id = p.id left join be on be.a_id = p.id where p.id % 50 = 0),
    o as (select *, {sql_half_up('raw', 2)} as spam_score from z)
    select id, spam_score, {VERDICT} as spam_verdict, concat_ws(',', {", ".join(f"case when {k} then '{k}' end" for k in REPORTED)}, case when reused > 0 then 'reused_text' end) as signals,
        coalesce(reused, 0) as reused, duplicate_of, duplicate_score, coalesce(duplicate_verdict, 'none') as duplicate_verdict from o""")
def report_verdict(t):
    """The whole check of a report (ids that 50 divides) against all others: signs of spam, topic, haste
    and reuse in one score and verdict, and its best duplicate, of ties the one with the smaller id."""
    vectors, places = text_vectors(t.documents, "doc_id"), placed(t)
    again = reused(vectors, places).groupBy(c("a_id").alias("id")).agg(F.count(F.lit(1)).alias("reused"))
    best = F.struct("score", (-c("b_id")).alias("first"))
    twins = duplicates(vectors, places).groupBy(c("a_id").alias("id")).agg(F.max_by("b_id", best).alias("duplicate_of"), F.max("score").alias("duplicate_score"), F.max_by("verdict", best).alias("duplicate_verdict"))
    asked_only = places.filter(asked(places)).select("id")
    rows = report_flags(t).withColumnRenamed("doc_id", "id").join(asked_only, "id", "left_semi").join(again, "id", "left").join(twins, "id", "left")
    rows = rows.withColumn("reused_text", F.coalesce("reused", F.lit(0)) > 0)
    weights = {**REPORTED, "reused_text": REUSE_WEIGHT}
    s = c("spam_score")
    scored = rows.withColumn("spam_score", half_up(noisy_or_of(weights_of(weights)), 2))
    return scored.select(
        "id", "spam_score", F.when(s >= 0.6, "likely_spam").when(s >= 0.3, "review").otherwise("ok").alias("spam_verdict"), F.concat_ws(",", *[F.when(c(k), k) for k in weights]).alias("signals"),
        F.coalesce("reused", F.lit(0)).alias("reused"), "duplicate_of", "duplicate_score", F.coalesce("duplicate_verdict", F.lit("none")).alias("duplicate_verdict"),
    )
