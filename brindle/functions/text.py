"""Text as Column expressions: normalisers and pre-tokenisers.

What SQL expressions can say runs in the JVM; Unicode normal forms, case
folding, scripts and byte maps run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def batch_udf(kind: str, f: Callable) -> Step:
    """A Python function of one string in Arrow batches; null stays null."""

    def step(c) -> Column:
        # Made when it is used: tasks import this module without a session.
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return run(_c(c))

    return step


# --- normalisers --------------------------------------------------------------

nfc, nfd, nfkc, nfkd = (batch_udf("string", lambda t, form=form: unicodedata.normalize(form, t)) for form in ("NFC", "NFD", "NFKC", "NFKD"))
#: Full case folding (sharp s becomes ss), more than lower case.
lowercase = batch_udf("string", str.casefold)


def python_strip_accents(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


strip_accents = batch_udf("string", python_strip_accents)


def strip(c, left: bool = True, right: bool = True) -> Column:
    c = _c(c)
    if left:
        c = F.regexp_replace(c, r"^(?U:\s+)", "")
    return F.regexp_replace(c, r"(?U:\s+)$", "") if right else c


def replace(c, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_c(c), pattern, replacement)


def prepend(c, prefix: str) -> Column:
    """Nothing before an empty text."""
    c = _c(c)
    return F.when(F.length(c) > 0, F.concat(F.lit(prefix), c)).otherwise(c)


def clean_text(c) -> Column:
    """White space to plain spaces; control characters and U+FFFD out."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\s", " "), r"[\p{Cc}\p{Cf}\x{FFFD}]", "")


def space_ideographs(c) -> Column:
    return F.regexp_replace(_c(c), r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}])", " $1 ")


def bert_normalize(c, lower: bool = True, accents: bool | None = None, clean: bool = True, ideographs: bool = True) -> Column:
    """Clean, space ideographs, strip accents (follows ``lower`` unless given), lower-case."""
    c = _c(c)
    c = clean_text(c) if clean else c
    c = space_ideographs(c) if ideographs else c
    c = strip_accents(c) if (lower if accents is None else accents) else c
    return lowercase(c) if lower else c


def sequence(*steps: Step) -> Step:
    return lambda c: reduce(lambda x, f: f(x), steps, _c(c))


# --- the byte alphabet --------------------------------------------------------


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else the next of those from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = byte_alphabet()
_BACK = {c: b for b, c in _BYTES.items()}


def to_bytes_text(t: str) -> str:
    return "".join(_BYTES[b] for b in t.encode())


def from_bytes_text(t: str) -> str:
    return bytes(_BACK[c] for c in t if c in _BACK).decode("utf-8", "replace")


byte_level_normalize = batch_udf("string", to_bytes_text)
byte_level_decode = batch_udf("string", from_bytes_text)

# --- pre-tokenisers: array of pieces ------------------------------------------


def _not_empty(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: F.length(p) > 0)


def whitespace(c) -> Column:
    """Runs of word characters and runs of anything else but white space."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?U:\w+)|(?U:[^\w\s]+)"), F.lit(0))


def whitespace_split(c) -> Column:
    return _not_empty(F.split(_c(c), r"(?U:\s+)"))


#: ASCII symbols count as punctuation too.
_PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"


def bert_pieces(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(rf"{_PUNCTUATION}|(?:(?!{_PUNCTUATION})(?U:\S))+"), F.lit(0))


def _behaviour(c, delimiter: str, behavior: str) -> Column:
    """Pieces around the matches of a regex for one character or string."""
    c = _c(c)
    other = rf"(?:(?!{delimiter})(?s:.))+"
    pattern = {
        "isolated": rf"{delimiter}|{other}", "contiguous": rf"(?:{delimiter})+|{other}", "removed": other,
        "merged_with_next": rf"{delimiter}(?:{other})?|{other}", "merged_with_previous": rf"(?:{other})?{delimiter}|{other}",
    }[behavior]
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def punctuation(c, behavior: str = "isolated") -> Column:
    return _behaviour(c, _PUNCTUATION, behavior)


def split_on(c, pattern: str, behavior: str = "removed", invert: bool = False) -> Column:
    """Around a literal string; inverted, what matches is kept and the rest is the delimiter."""
    literal = "".join(rf"\x{{{ord(x):X}}}" for x in pattern)
    if invert:
        return _behaviour(c, rf"(?!{literal})(?<!{literal})(?s:.)", behavior) if behavior != "removed" else F.regexp_extract_all(_c(c), F.lit(literal), F.lit(0))
    return _behaviour(c, literal, behavior)


def char_delimiter(c, delimiter: str) -> Column:
    return split_on(c, delimiter)


def digits(c, individual: bool = False) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"[0-9]|[^0-9]+" if individual else r"[0-9]+|[^0-9]+"), F.lit(0))


def fixed_length(c, n: int) -> Column:
    """Pieces of ``n`` code points, the last one shorter; none if n isn't positive."""
    c = _c(c)
    if n <= 0:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(n)), lambda i: F.substring(c, i, F.lit(n)))).when(c.isNotNull(), F.array().cast("array<string>"))


def metaspace(c, replacement: str = "_", prepend_scheme: str = "always", split: bool = True) -> Column:
    """Spaces to a marker; a piece begins at each marker."""
    c = F.replace(_c(c), F.lit(" "), F.lit(replacement))
    if prepend_scheme != "never":
        c = F.when(F.startswith(c, F.lit(replacement)) | (F.length(c) == 0), c).otherwise(F.concat(F.lit(replacement), c))
    if not split:
        return _not_empty(F.array(c))
    r = re.escape(replacement)
    return F.regexp_extract_all(c, F.lit(rf"{r}[^{r}]*|[^{r}]+"), F.lit(0))


# Contractions, letters, numbers, other signs, white space: the usual byte-level split (fixed value).
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(c, add_prefix_space: bool = True, use_regex: bool = True) -> Column:
    """Pieces in the byte alphabet."""
    c = _c(c)
    if add_prefix_space:
        c = F.when(F.startswith(c, F.lit(" ")) | (F.length(c) == 0), c).otherwise(F.concat(F.lit(" "), c))
    pieces = F.regexp_extract_all(c, F.lit(_BYTE_SPLIT), F.lit(0)) if use_regex else F.array(c)

    @F.pandas_udf("array<string>")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda ps: [to_bytes_text(p) for p in ps], na_action="ignore")

    return encode(pieces)


def _script(ch: str) -> str:
    """The first word of a letter's Unicode name, which for letters is its script."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ")[0]
    return "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA") else name


def python_scripts(t: str) -> list[str]:
    out: list[str] = []
    last = ""
    for ch in t:
        s = _script(ch)
        if s and last and s != last:
            out.append(ch)
        elif out:
            out[-1] += ch
        else:
            out.append(ch)
        last = s or last
    return [p.strip() for p in out if p.strip()]


unicode_scripts = batch_udf("array<string>", python_scripts)


def then(pieces: Column, step: Step) -> Column:
    """Each piece split again."""
    return F.flatten(F.transform(pieces, step))


def with_offsets(c, pieces: Column) -> Column:
    """(piece, start, end) in code points, for pieces that occur in the text in order: one pass over each text."""

    @F.arrow_udf("array<struct<piece:string,start:int,end:int>>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        found, starts, ends, sizes = lists.flatten(), [], [], [0]
        lost = pc.or_(lists.is_null(), texts.is_null())
        for t, ps in zip(texts, lists, strict=True):
            t, ps, at = t.as_py(), ps.as_py() or (), 0
            for p in ps:
                start = -1 if t is None else t.find(p, at)
                at = start + len(p)
                starts.append(start)
                ends.append(at)
            sizes.append(len(starts))
        spans = pa.StructArray.from_arrays([found, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["piece", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans, mask=lost)

    return run(_c(c), pieces)


def cut(c, spans: Column) -> Column:
    """The parts of a text from ``start`` to ``end`` of each span, in code points."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        parts, sizes = [], [0]
        lost = pc.or_(starts.is_null(), texts.is_null())
        for t, first, last in zip(texts, starts, ends, strict=True):
            if (t := t.as_py()) is not None:
                parts.append(pa.array([t[i:j] for i, j in zip(first.as_py() or (), last.as_py() or (), strict=True)], pa.string()))
            sizes.append(sizes[-1] + (len(parts[-1]) if t is not None else 0))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.string()), mask=lost)

    return run(_c(c), spans["start"], spans["end"])
