"""Personal data by weak supervision.

Generators propose spans; five labelers vote on each (+1 personal, -1 not, 0
abstain): the kind's strict pattern, its validity rule, a gazetteer, the words
before it, and how it stands in the text. Votes and two shape features make a
pattern; there are at most ``PATTERNS`` patterns, so their counts over all
documents are a small table. Expectation-maximisation on that table estimates
how reliable each labeler is, without labels, and its posteriors train a
logistic span classifier, which decides on the proposals. The spans of the four
base kinds always stay; the classifier adds spans of the further kinds.

Offsets are code points, end exclusive. Texts are read whole, once.

Rows: null text is empty. Null ids and repeated rows are handled like any
other row. Only the id and text columns are read; ``redact`` keeps the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "masked_email", "national_id", "iban", "person")
LABELERS = ("pattern", "validity", "gazetteer", "context", "standing")
SHAPES = 6
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * SHAPES

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Matches of the three digit kinds lie within such a run.
_ISLAND = re.compile(r"[0-9+][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{1,4}(?![A-Za-z0-9])")
_MASK = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]{1,63})+")
_PERSON = re.compile(r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\. [^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)?")

# Gazetteers and cues.
_TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it eu us ca au jp cn in br ch at be nl se no dk fi pl".split())
_AREA_STARTS = frozenset("23456789")
_NAMES = frozenset("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria peter hans klaus ursula pierre marie jean claire luis carmen jose ana juan".split())
_CUES = {
    0: "email e-mail mail contact write reach", 1: "ip address host server from", 2: "card visa credit payment mastercard", 3: "phone tel telephone call mobile fax",
    4: "phone tel telephone call mobile fax", 5: "email e-mail mail contact write reach", 6: "ssn social security", 7: "iban account konto bank", 8: "name contact signed dear regards",
}
_CUES = {k: frozenset(v.split()) for k, v in _CUES.items()}
_AGAINST = frozenset("version release isbn issn order invoice page section figure table part serial".split())
_WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every proposal: base kinds first as they stand, then further ones that overlap none of these."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    more: list[tuple[int, int, int]] = []
    digits = False
    for island in _ISLAND.finditer(text):
        a, b = island.span()
        if b - a < 2:
            continue
        digits = True
        s = island[0]
        if "." in s:
            out += [(1, a + m.start(), a + m.end()) for m in _IP.finditer(s) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(s):
            if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, a + m.start(), a + m.end()))
        if "+" in s:
            out += [(3, a + m.start(), a + m.end()) for m in _PHONE.finditer(s) if 8 <= len(_digits(m[0])) <= 15]
        if b - a >= 11:
            more += [(6, a + m.start(), a + m.end()) for m in _NATIONAL.finditer(s)]
            more += [(4, a + m.start(), a + m.end()) for m in _LOCAL_PHONE.finditer(s)]
    if digits:
        more += [(7, *m.span()) for m in _IBAN.finditer(text)]
    if _MASK.search(text):
        more += [(5, *m.span()) for m in _MASKED.finditer(text)]
    more += [(8, *m.span()) for m in _PERSON.finditer(text)]
    if more:
        taken = sorted((s, e) for _, s, e in out)
        kept, last = [], 0
        for k, s, e in sorted(more, key=lambda x: (x[1], x[0])):
            if s >= last and not any(x < e and s < y for x, y in taken):
                kept.append((k, s, e))
                last = e
        out += kept
    out.sort()
    return out


def pattern_code(text: str, kind: int, start: int, end: int) -> int:
    """The votes of the labelers and the shape of a span, as one number below ``PATTERNS``."""
    s = text[start:end]
    digits = sum("0" <= c <= "9" for c in s)
    strict = {0: _DOMAIN.search(s.rpartition("@")[2]) is not None and ".." not in s, 1: s.count(".") == 3, 2: len(set(_digits(s))) > 2, 3: 10 <= digits <= 13, 4: digits == 10, 5: " " in s or "[" in s, 6: True, 7: True, 8: " " in s}[kind]
    if kind == 0 or kind == 5:
        valid = 1 if len(s) <= 254 and not s.startswith(".") else -1
    elif kind == 1:
        valid = -1 if s.startswith(("0.", "255.")) else 1
    elif kind == 2:
        valid = 1 if luhn(_digits(s)) else -1
    elif kind == 6:
        valid = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    elif kind == 7:
        valid = 1 if _iban_valid(s) else -1
    elif kind == 8:
        valid = 0
    else:
        valid = 1 if len(set(_digits(s))) > 2 else -1
    if kind in (0, 5):
        known = 1 if re.split(r"[^A-Za-z]+", s.rstrip(".)] "))[-1].lower() in _TLDS else -1
    elif kind == 2:
        known = 1 if s[0] in "3456" else -1
    elif kind == 4:
        known = 1 if _digits(s)[0] in _AREA_STARTS else -1
    elif kind == 8:
        known = 1 if any(w.lower() in _NAMES for w in s.split()[1:]) else 0
    else:
        known = 0
    before = _WORD.findall(text[max(0, start - 40) : start].lower())
    context = 1 if any(w in _CUES[kind] for w in before) else -1 if any(w in _AGAINST for w in before[-2:]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    standing = 1 if not left.isalnum() and not right.isalnum() else -1
    shape = min(2, (end - start) // 12) * 2 + (digits * 2 > end - start)
    code = kind
    for v in (1 if strict else -1, valid, known, context, standing):
        code = code * 3 + v + 1
    return code * SHAPES + shape


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes in 0..2 by labeler, shape) of pattern numbers."""
    shape, rest = codes % SHAPES, codes // SHAPES
    votes = []
    for _ in LABELERS:
        votes.append(rest % 3)
        rest = rest // 3
    return rest, np.stack(votes[::-1], 1), shape


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, [class, labeler, vote] probabilities) by expectation-maximisation.

    Two classes, labelers independent given the class, a prior for each kind;
    starts from the share of positive votes.
    """
    kind, votes, _ = decode(codes)
    signed = votes - 1
    p = 1 / (1 + np.exp(-1.5 * signed.sum(1)))
    theta = np.empty((2, len(LABELERS), 3))
    for _ in range(rounds):
        for c, w in enumerate((counts * (1 - p), counts * p)):
            for j in range(len(LABELERS)):
                n = np.bincount(votes[:, j], w, 3) + np.array([(2.0, 1.0, 0.5), (0.5, 1.0, 2.0)][c])
                theta[c, j] = n / n.sum()
        prior = (np.bincount(kind, counts * p, len(KINDS)) + 1) / (np.bincount(kind, counts, len(KINDS)) + 2)
        logs = np.log(theta)
        score = np.log(prior / (1 - prior))[kind] + sum((logs[1] - logs[0])[j][votes[:, j]] for j in range(len(LABELERS)))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, theta


def classifier(codes: np.ndarray, counts: np.ndarray, target: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """The probability that a logistic model of kind, votes and shape, fitted to the posteriors, gives each pattern."""
    kind, votes, shape = decode(codes)
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, j]] for j in range(len(LABELERS))), np.eye(SHAPES)[shape]], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (counts * (target - p)) - ridge * w)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit(table: dict[int, int], least: float = 0.5) -> frozenset[int]:
    """The patterns whose spans are personal data, from the counts of all patterns."""
    if not table:
        return frozenset()
    codes = np.array(sorted(table))
    counts = np.array([table[c] for c in codes.tolist()], float)
    posterior, _ = reliabilities(codes, counts)
    return frozenset(codes[classifier(codes, counts, posterior) >= least].tolist())


def _counts(found: DataFrame) -> dict[int, int]:
    """The table of pattern counts: at most ``PATTERNS`` rows reach the driver."""
    return {r["code"]: r["n"] for r in found.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, found): every proposal of every row, as (kind, start, end, code), in one pass."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))
        for batch in batches:
            out = []
            for t in batch.column(1):
                t = t.as_py() or ""
                out.append([{"kind": k, "start": s, "end": e, "code": pattern_code(t, k, s, e)} for k, s, e in spans(t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["__id", "found"])

    t = _texts(docs, id_col, text_col)
    return t.mapInArrow(run, f"__id {t.schema['__id'].dataType.simpleString()}, found array<struct<kind:int,start:int,end:int,code:int>>")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id as ``__id`` and ``found``, the spans kept, by kind and start."""
    found = materialize(scan(docs, id_col, text_col), "proposals")
    accepted = fit(_counts(found.select(F.explode("found").alias("s")).select("s.code").groupBy("code").agg(F.count("*").alias("n"))))
    yes = F.array(*(F.lit(int(c)) for c in sorted(accepted))).cast("array<int>")
    return found.select("__id", F.filter("found", lambda s: (s["kind"] < len(BASE)) | F.array_contains(yes, s["code"])).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans of ``find_pii``."""
    names = F.array(*map(F.lit, KINDS))

    def joined(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(F.col("__id").alias(id_col), *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by [KIND]; the length column, if there is one, follows.

    Two passes over the texts, the first for the pattern counts; nothing but these is shuffled.
    """

    def count(batches):
        n: Counter[int] = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py() or ""
                n.update(pattern_code(t, k, s, e) for k, s, e in spans(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["code", "n"])

    t = docs.select(F.col(text_col).cast("string").alias("__text"))
    accepted = fit(_counts(t.mapInArrow(count, "code int, n long")))
    at = docs.columns.index(text_col)
    measured = docs.columns.index(length_col) if length_col in docs.columns else None

    def replace(batches):
        for batch in batches:
            out = []
            for value in batch.column(at):
                t = value.as_py()
                parts, last = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in spans(t or "") if k < len(BASE) or pattern_code(t, k, s, e) in accepted):
                    if s >= last:
                        parts += [t[last:s], f"[{KINDS[k].upper()}]"]
                    last = max(last, e)
                out.append("".join([*parts, t[last:]]) if parts else t)
            batch = batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(out, pa.string()))
            if measured is not None:
                field = batch.schema.field(measured)
                batch = batch.set_column(measured, field, pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(field.type))
            yield batch

    return docs.mapInArrow(replace, docs.schema)


def python_digest(text: str | None) -> tuple[list[int], str]:
    """The plain base rule, for tests: counts by kind and base_sha256."""
    t = text or ""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(_digits(m[0])) <= 15]
    text_of = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
    return [sum(k == b for k, _ in found) for b in BASE], hashlib.sha256(text_of.encode()).hexdigest()
