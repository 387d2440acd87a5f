"""Secret scans over a trigram inverted index, in DataFrame operations only.

For each rule's regular expression a Boolean query of trigrams that every
match must hold is derived from its syntax tree. The index posts each
document under the trigrams that some rule needs; intersecting the postings
of a query's conjunctions leaves candidates, on which alone the regex runs.
A rule without a mandatory trigram scans every text.

Offsets come from splitting a text at its matches: code points, end exclusive.

Rows: null text is empty. Repeated rows and null ids are scanned like any
other, each on its own. Only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, is_small, materialize


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regex that Java, RE2 and Python read alike; ``group`` of ``least`` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    groups: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is the leftmost match of [0-9a-f]+ that isn't dropped for its length.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}"),
)
RULES = BASE + MORE

#: A query in disjunctive form: any of these sets of trigrams, all of whose members must be there.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST_EXACT, MOST_CLASS, MOST_TERMS = 64, 8, 256


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MOST_TERMS else min(a, b, key=len)


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _needs(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that a match can be, if few, else None; what every match must hold)."""
    whole, query, run = True, ANY, {""}

    def part(op, arg) -> tuple[set[str] | None, Query]:
        if op is C.LITERAL:
            return {chr(arg).lower()}, ANY
        if op is C.IN and not any(o is C.NEGATE for o, _ in arg):
            chars: set[str] = set()
            for o, a in arg:
                if o is C.LITERAL:
                    chars.add(chr(a).lower())
                elif o is C.RANGE and a[1] - a[0] < 2 * MOST_CLASS:
                    chars |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
                else:
                    return None, ANY
            return (chars if len(chars) <= MOST_CLASS else None), ANY
        if op is C.SUBPATTERN:
            return _walk(arg[3])
        if op is C.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in found):
                return set().union(*(e for e, _ in found)), ANY
            return None, _least(frozenset().union(*(_needs(e) if e is not None else q for e, q in found)))
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            exact, inner = _walk(body)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {""}, ANY
            if exact is not None and low == high and low <= 8 and len(exact) ** low <= MOST_EXACT:
                return {"".join(x) for x in itertools.product(exact, repeat=low)}, ANY
            return None, (_needs(exact) if exact is not None else inner) if low else ANY
        return None, ANY

    for op, arg in items:
        exact, inner = part(op, arg)
        if exact is not None and len(exact) * len(run) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        query = _both(_both(query, _needs(run)), _needs(exact) if exact is not None else inner)
        run = {""}
    return (run, ANY) if whole else (None, _both(query, _needs(run)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text must hold to match: any of these sets; ``ANY`` if none is sure."""
    exact, query = _walk(parser.parse(pattern))
    return _needs(exact) if exact is not None else query


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, __id, __text_hash): postings of the lower-cased texts, for the given trigrams."""
    hay = docs.select("__id", "__text_hash", F.lower("__text").alias("hay"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("hay"), t))
    return hay.select("__id", "__text_hash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(__id, __text_hash, kinds): documents that hold all trigrams of a conjunction of a rule's query."""
    rows = [(t, n, len(terms), r.kind) for n, (r, terms) in enumerate((r, x) for r in rules for x in sorted(trigram_query(r.pattern), key=sorted)) for t in sorted(terms)]
    plan = index.sparkSession.createDataFrame(rows, "trigram string, term int, need int, kind string")
    met = index.distinct().join(F.broadcast(plan), "trigram").groupBy("__id", "__text_hash", "term", "need", "kind").count().where("count = need")
    return met.groupBy("__id", "__text_hash").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, end) of the rule's matches that are long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    sizes = F.arrays_zip(F.transform(between, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("size"), F.transform(checked, F.char_length).alias("checked"))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["checked"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: the id as ``__id`` and ``found``, an array of (start, order, end) by start and rule."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__text_hash", F.xxhash64("__text"))
    indexed = tuple(r for r in rules if frozenset() not in trigram_query(r.pattern))
    scanned = tuple(r for r in rules if r not in indexed)
    text, order = F.col("__text"), {r: i for i, r in enumerate(rules)}
    merged = lambda rs: F.array_sort(F.flatten(F.array(*(_spans(r, order[r], text) for r in rs))))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    out = rows.select("__id", "__text_hash", (merged(scanned) if scanned else none).alias("all"))
    if not indexed:
        return out.select("__id", F.col("all").alias("found"))
    grams = sorted({t for r in indexed for terms in trigram_query(r.pattern) for t in terms})
    hits = materialize(candidates(build_index(rows, grams), indexed), "candidates")
    hits = hits.withColumnRenamed("__id", "__hit").withColumnRenamed("__text_hash", "__hit_hash")
    same = F.col("__id").eqNullSafe(F.col("__hit")) & (F.col("__text_hash") == F.col("__hit_hash"))
    side = F.broadcast(hits) if is_small(hits) else hits
    # On the text-bearing side only candidates remain; with a small list of them, nothing is shuffled.
    kept = rows.join(side, same)
    per_rule = F.array(*(F.when(F.array_contains("kinds", r.kind), _spans(r, order[r], text)).otherwise(none) for r in indexed))
    verified = kept.select(F.col("__hit"), F.col("__hit_hash"), F.flatten(per_rule).alias("more")).where(F.size("more") > 0)
    verified = materialize(verified.dropDuplicates(["__hit", "__hit_hash"]), "verified")
    verified = F.broadcast(verified) if is_small(verified, 200_000) else verified
    joined = out.join(verified, same, "left")
    assert spark is not None
    return joined.select("__id", F.array_sort(F.concat("all", F.coalesce("more", none))).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of ``find_secrets``."""
    names = F.array(*(F.lit(r.kind) for r in rules))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")

    count = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("long")
    return found.select(
        F.col("__id").alias(id_col), *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])),
        F.sha2(joined(F.filter("found", lambda s: s["order"] < base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def _masked(text: Column, spans: Column, kind: str) -> Column:
    """``text`` with each of its spans replaced by [KIND]."""

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(f"[{kind.upper()}]")).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each match of a rule that is long enough replaced by [KIND] in the text column, a rule after the other."""
    rows, spans, text = docs.withColumn(text_col, F.col(text_col).cast("string")), free(docs, "__spans"), F.col(text_col)
    for r in rules:
        rows = rows.withColumn(spans, _spans(r, 0, text)).withColumn(text_col, F.when(F.size(spans) > 0, _masked(text, F.col(spans), r.kind)).otherwise(text))
    return rows.select(*docs.columns)


def python_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The plain rule, for tests: (start, order, end) of every match, by start and rule."""
    found = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(found)
