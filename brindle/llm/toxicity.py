"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps homoglyphs (letters of other scripts, full-width forms), digit
and sign substitutions inside words, and accents, to plain lower-case letters,
and drops what splits a word unseen (zero-width and other format characters). The automaton holds the lexicon's words and stems;
hits must begin where a word begins (whole words must also end there); hits
inside an exception phrase don't count. Each entry adds its weight once for
each hit; the sum is normalised by the length of the text and mapped to a
probability by a fitted logistic curve.

``fit`` learns the entries and weights from labelled rows: of each label the
``fit_rows`` rows of lowest hash at most (a documented bound; each row of a
group of copies that shares its smallest shingle counts once).

Rows: null text is empty. Labels that are null or whose document is missing
are not used; of repeated labels the highest counts. Without labels the
built-in seed lexicon is used. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shingles, text_buffers, words

#: Letters of other scripts that look like Latin ones.
_GLYPHS = str.maketrans("авекмнорстухіјѕԁɡӏɑαβερικοντυχ", "abekmhopctyxijsdglaabepikovtux")
#: Digits and signs that stand for letters within a word.
_SIGNS = str.maketrans("01345789@$!|", "oieastbgasil")
_WORD = re.compile(r"[^\W_][\w@$!|*'-]*", re.UNICODE)
#: Used where no labels are given: plain insults, each with its weight.
SEED = {"idiot": 2.0, "moron": 2.0, "scum": 2.0, "stupid": 1.5, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.2, "loser": 1.5, "trash": 1.0, "clown": 1.0}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "pathetic fallacy", "sore loser rule")
STEMS = (4, 5, 6)


class _Characters(dict):
    """What each character is folded to: lower case without accents, in Latin letters; nothing for a mark or a format character."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
        self[code] = folded = unicodedata.normalize("NFKC", plain).lower().translate(_GLYPHS)
        return folded


class _Words(dict):
    """What each word is folded to, for the words met last."""

    def __missing__(self, word: str) -> str:
        w = word
        if not w.isalpha():
            if any(c.isalpha() for c in w):
                w = w.rstrip("!|'-*").translate(_SIGNS)
            w = "".join(c for c in w if c.isalnum())
        if len(word) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[word] = w
        return w


_CHARACTERS, _WORDS = _Characters(), _Words()


def fold(text: str) -> str:
    """Lower-case words joined by single spaces, disguises undone; a space at each end. Each character is folded by itself."""
    text = text.lower() if text.isascii() else text.translate(_CHARACTERS)
    return f" {' '.join(filter(None, map(_WORDS.__getitem__, _WORD.findall(text))))} "


@dataclass
class Model:
    """``weights``: entries, a stem ends with ``*``; ``slope`` and ``offset`` map the normalised sum to log odds."""

    weights: dict[str, float]
    slope: float = 4.0
    offset: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def machine(self):
        if self._machine is None:
            m = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                key = " " + (entry[:-1] if entry.endswith("*") else entry + " ")
                m.add_word(key, (len(key), weight))
            for phrase in self.exceptions:
                m.add_word(f" {phrase} ", (len(phrase) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def raw(self, text: str) -> float:
        """The weights of the hits, one hit a word, over the text's length: log-scaled, so that neither a long text hides a hit nor one word sinks a book."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.weights):
            for end, (size, weight) in self.machine().iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    best[start] = max(best.get(start, 0.0), weight)
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        n = folded.count(" ") - 1
        return sum(best.values()) / (1 + math.log1p(max(n, 0) / 200))

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(text or "") + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(folded: str) -> set[str]:
    """A text's words and stems, each once."""
    found = set(folded.split())
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


def held_out(id_col: str = "doc_id"):
    """Column: whether the row's label must not be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(toxic, text): at most ``fit_rows`` labelled rows of each label, by the hash of the id."""
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__toxic")).where("__id is not null and __toxic is not null")
    lab = lab.where(~held_out("__id")).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    parts = [lab.where(F.col("__toxic") == v).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows) for v in (0, 1)]
    chosen = parts[0].union(parts[1])
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # At most 2 * fit_rows short rows: small enough to broadcast at any size of the corpus.
    return text.join(F.broadcast(chosen), "__id").select(F.col("__toxic").cast("int").alias("toxic"), F.col("__text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 6000, least: int = 4, entries: int = 20_000) -> Model:
    """Learn the lexicon, its weights and the curve.

    An entry's weight is its smoothed log odds ratio; it is kept if it stands
    in ``least`` toxic texts, in 0.6 % of them, and is much likelier in these.
    ``entries`` bounds the lexicon by weight times support.
    """

    def kept_once(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            hashed, _, _, first = words(data, offsets)
            h, _, starts = shingles(hashed, first)
            low = np.zeros(batch.num_rows, np.uint64)
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                low[full] = np.minimum.reduceat(h, starts[:-1][full])
            yield batch.append_column("low", pa.array(low.view(np.int64)))

    sample = _examples(docs, labels, id_col, text_col, label_col, fit_rows).mapInArrow(kept_once, "toxic int, text string, low long")
    sample = materialize(sample.dropDuplicates(["toxic", "low"]).select("toxic", "text"), "labelled")

    def count(batches):
        n: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[int(toxic > 0)].update(_terms(fold(t.as_py() or "")))
        terms = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "bad", "good"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(dict(SEED))
    share = (F.col("bad") + 0.1) / (bad + 1) / ((F.col("good") + 0.1) / (good + 1))
    table = sample.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    table = table.where(F.col("bad") >= max(least, 0.006 * bad)).withColumn("w", F.log(share)).where("w > 2.5").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "term").limit(entries)
    found = {r["term"]: (r["w"], r["bad"]) for r in table.select("term", "w", "bad").collect()}
    weights = {}
    for term, (w, n) in found.items():
        stem = [term.rstrip("*")[:k] + "*" for k in STEMS if k < len(term.rstrip("*"))]
        if any(s in found and found[s][1] >= n and found[s][0] >= w - 0.3 for s in stem):
            continue  # the shorter stem says it all
        weights[term] = float(w) / 5
    model = Model(weights)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(min(model.raw(t.as_py() or ""), 50.0), 2) for t in batch.column(1)], pa.float64())], ["toxic", "raw"])

    binned = sample.mapInArrow(measure, "toxic int, raw double").groupBy("toxic", "raw").count().collect()  # at most 5001 values of raw
    x = np.array([r["raw"] for r in binned])
    y = np.array([float(r["toxic"] > 0) for r in binned])
    c = np.array([float(r["count"]) for r in binned])
    w = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (c * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (c * (y - p)) - 0.05 * w)
        w = w + np.clip(step, -2, 2)
    return Model(weights, float(max(w[0], 0.01)), float(w[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: the id, score (0 to 1) and predicted (1 if score >= threshold)."""

    def run(batches):
        for batch in batches:
            s = np.array([model.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["__id", "score", "predicted"])

    t = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = t.mapInArrow(run, f"__id {t.schema['__id'].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("__id", id_col)


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, with a model fitted to the labels that may be learnt from."""
    out = score(docs, fit(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, in one more pass over the texts."""
    model = fit(docs, labels, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def python_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
