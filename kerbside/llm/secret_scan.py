"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that any match must hold.
One pass over the texts writes ``postings``, the table (trigram, id) of the trigrams of these
queries. ``candidates`` intersects the postings of each clause, ids alone; the ids then meet the
texts, and a rule's expression verifies those that it has a clause of. Rules without mandatory
trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MOST_STRINGS = 96
MOST_SET = 8
#: Trigrams of a clause that are looked up: fewer ask for less, so they only widen the candidates.
CLAUSE_TERMS = 2
#: Letters that are frequent in prose: trigrams with few of them are looked up first.
FREQUENT = "etaoinshrdlu "
#: Candidate ids that are broadcast to the texts (about 50 MB); more of them meet by a shuffle.
MOST_BROADCAST = 1 << 19


@dataclass(frozen=True)
class Rule:
    kind: str
    #: group 0 is the span; the same pattern in Java's and Python's dialect
    pattern: str
    #: matches whose group has fewer characters are dropped
    group: int = 0
    least: int = 1


#: The kinds that every scan has, in the order that breaks ties.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Kinds that are added to them.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


# --- trigram queries ------------------------------------------------------------------


def trigrams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def absorb(clauses) -> set:
    """Drop clauses that demand more than another one."""
    return {c for c in clauses if not any(o < c for o in clauses)}


def trigram_query(pattern: str) -> set | None:
    """Clauses (sets of lower-case trigrams) of which any match holds one; None if a match
    may hold no trigram at all."""
    required = [set(map(trigrams, strings)) for strings in literal_runs(_parser.parse(pattern))]
    required = [clauses for clauses in required if all(clauses)]
    if not required:
        return None
    out = {frozenset()}
    for clauses in required:
        if len(out) * len(clauses) <= MOST_STRINGS:
            out = absorb({a | b for a in out for b in absorb(clauses)})
    return out


def literal_runs(tree) -> list[set[str]]:
    """Sets of strings one of which each match holds; neighbours that are finite are joined."""
    runs: list[set[str]] = []
    now = {""}

    def flush():
        nonlocal now
        if now != {""}:
            runs.append(now)
        now = {""}

    for node in tree:
        found = finite(node)
        if found is not None and len(now) * len(found) <= MOST_STRINGS:
            now = {a + b for a in now for b in found}
            continue
        flush()
        if found is not None:
            now = found
            continue
        kind, value = node
        if kind is op.SUBPATTERN:
            runs += literal_runs(value[3])
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            runs += literal_runs(value[2])
    flush()
    return runs


def finite(node) -> set[str] | None:
    """All lower-cased strings of a part, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        chars = set()
        for k, v in value:
            if k is not op.LITERAL:
                return None
            chars.add(chr(v).lower())
        return chars if len(chars) <= MOST_SET else None
    if kind is op.SUBPATTERN:
        return finite_sequence(value[3])
    if kind is op.BRANCH:
        parts = [finite_sequence(x) for x in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 2:
        part = finite_sequence(value[2])
        if part is None:
            return None
        out, power = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= power
            power = {a + b for a in power for b in part}
        return out if len(out) <= MOST_STRINGS else None
    return None


def finite_sequence(tree) -> set[str] | None:
    out = {""}
    for node in tree:
        found = finite(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


# --- the scan -------------------------------------------------------------------------


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, rank, end, kind) in code points.
    The text between matches and the matches themselves give the offsets."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        low = acc["at"] + F.length(m["0"])
        high = low + F.length(m["1"])
        span = F.struct(low.alias("start"), F.lit(rank).alias("rank"), high.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(m["2"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(high.alias("at"), kept.alias("spans"))

    zipped = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, measured)
    return F.aggregate(zipped, start, step)["spans"]


def shortened(clauses: set, most: int = CLAUSE_TERMS) -> list[tuple]:
    """Of each clause its rarest trigrams, in order."""
    rare = lambda t: (sum(ch in FREQUENT for ch in t), t)
    return sorted({tuple(sorted(sorted(c, key=rare)[:most])) for c in clauses})


def lookup_pattern(terms: list[str]) -> str:
    """An expression that matches, without width, where one of the trigrams stands; group 1 is
    the trigram. Terms share their first letters, so most places are left after one look."""
    by: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(terms):
        by.setdefault(a, {}).setdefault(b, []).append(c)
    second = lambda m: "|".join(f"{re.escape(b)}[{''.join(map(re.escape, c))}]" for b, c in m.items())
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{second(m)})" for a, m in by.items()) + "))"


def held_terms(text: Column, terms: list[str]) -> Column:
    """The distinct ones of ``terms`` that a text holds, its letters in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(lookup_pattern(terms)), F.lit(1)))


def terms_of(rules: tuple) -> tuple[dict[int, list[tuple]], list[str]]:
    """Clauses by rule, without rules that have no mandatory trigram, and all their trigrams."""
    queries = {i: shortened(q) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    return queries, sorted({t for clauses in queries.values() for clause in clauses for t in clause})


def postings(docs: DataFrame, rules: tuple = BASE_RULES + MORE_RULES) -> DataFrame:
    """(term, doc_id): the index over (doc_id, text), restricted to the trigrams that the rules
    ask for. Null and empty texts have no postings; rows that repeat post again."""
    return docs.select(F.explode(held_terms(F.coalesce("text", F.lit("")), terms_of(rules)[1])).alias("term"), "doc_id")


def candidates(index: DataFrame, rules: tuple = BASE_RULES + MORE_RULES) -> DataFrame:
    """(asked_id, asked: array of places in ``rules``): the ids that stand in the postings of all
    trigrams of a clause of these rules. Each posting meets the clauses that ask for its trigram;
    an id is in the intersection when it has met all places of the clause, each a bit. Null ids
    are in no row; an id on many rows has the trigrams of all of them."""
    queries, _ = terms_of(rules)
    clauses = [(i, n, 1 << at, (1 << len(clause)) - 1, term) for i, found in queries.items() for n, clause in enumerate(found) for at, term in enumerate(clause)]
    asked = index.sparkSession.createDataFrame(clauses, "rule int, clause int, bit int, whole int, term string")
    met = index.filter("doc_id is not null").join(F.broadcast(asked), "term").groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"))
    return met.filter("bits = whole").groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_set("rule").alias("asked"))


def scan_secrets(docs: DataFrame, rules: tuple = BASE_RULES + MORE_RULES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, text) to (doc_id, found: array of (start, rank, end, kind)) for every row.

    Null and empty texts have no spans; texts are scanned whole; repeated rows and null ids
    stay; an empty table gives an empty one; extra columns are not looked at. Rules see
    letters in either case only where their pattern says so (ASCII letters). Spans that start
    together are in the order of their rules.
    """
    queries, terms = terms_of(rules)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if terms:
        found = checkpoint(candidates(checkpoint(postings(docs, rules)), rules))
        found = F.broadcast(found) if found.count() <= most_broadcast else found
        rows = rows.join(found, F.col("doc_id") == F.col("asked_id"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    text, parts = F.col("text"), []
    for i, rule in enumerate(rules):
        # rows without an id have no postings, so all rules look at them
        asked = F.col("doc_id").isNull() | F.coalesce(F.array_contains("asked", i), F.lit(False)) if i in queries else F.lit(True)
        parts.append(F.when(asked & text.rlike(rule.pattern), rule_spans(text, rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, rules: tuple = BASE_RULES + MORE_RULES) -> DataFrame:
    """Counts and digests of ``scan_secrets``, a row for every row; empty texts have the digest
    of the empty string. Other cases are as there."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs, rules).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
