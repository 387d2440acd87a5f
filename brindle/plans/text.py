"""Queries of the text functions. Texts are made ASCII where the SQL's regular expressions know nothing else."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokenizers as K
from ..operators import ordered
from .registry import query, table

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"
_T = f"(SELECT doc_id, {_ASCII} AS t FROM documents)"


def _ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("t"))


def _pieces(name: str, make, sql: str) -> None:
    """Per document: how many pieces, and what they are."""

    @query(f"text_{name}", f"SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, chr(1))) AS h FROM (SELECT doc_id, {sql} AS p FROM {_T})")
    def f(spark, d):
        t = _ascii(spark, d).select("doc_id", make("t").alias("p"))
        return t.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\u0001").cast("binary")).alias("h"))


_pieces("whitespace", X.whitespace, r"regexp_extract_all(t, '\w+|[^\w\s]+')")
_pieces("whitespace_split", X.whitespace_split, r"list_filter(regexp_split_to_array(t, '[ \t\n\r\f\v]+'), lambda x: x <> '')")
_pieces("digits", X.digits, "regexp_extract_all(t, '[0-9]+|[^0-9]+')")
_pieces("digits_individual", lambda c: X.digits(c, True), "regexp_extract_all(t, '[0-9]|[^0-9]+')")
_pieces("fixed_length", lambda c: X.fixed_length(c, 7), "list_transform(range(0, ((length(t) + 6) // 7)::BIGINT), lambda i: substr(t, i * 7 + 1, 7))")
_pieces("char_delimiter", lambda c: X.char_delimiter(c, ","), "list_filter(string_split(t, ','), lambda x: x <> '')")
_pieces("punctuation", X.punctuation, r"regexp_extract_all(t, '[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+')")
_pieces("punctuation_contiguous", lambda c: X.punctuation(c, "contiguous"), r"regexp_extract_all(t, '[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~]+')")
_pieces("punctuation_removed", lambda c: X.punctuation(c, "removed"), r"regexp_extract_all(t, '[^!-/:-@\[-`{-~]+')")
_pieces("bert", X.bert_pieces, r"regexp_extract_all(t, '[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~\s]+')")
_pieces("metaspace", X.metaspace, "regexp_extract_all(CASE WHEN t = '' OR starts_with(replace(t, ' ', '_'), '_') THEN replace(t, ' ', '_') ELSE concat('_', replace(t, ' ', '_')) END, '_[^_]*|[^_]+')")


@query("text_normalize", f"SELECT doc_id, md5(lower(trim(regexp_replace(t, 'e', 'E', 'g'), chr(32) || chr(10) || chr(9) || chr(13)))) AS h, md5(CASE WHEN t = '' THEN t ELSE concat('>', t) END) AS p FROM {_T}")
def text_normalize(spark, d):
    norm = X.sequence(lambda c: X.replace(c, "e", "E"), X.strip, X.lowercase)
    return _ascii(spark, d).select("doc_id", F.md5(norm("t").cast("binary")).alias("h"), F.md5(X.prepend("t", ">").cast("binary")).alias("p"))


_WORDS = r"SELECT unnest(list_filter(regexp_split_to_array(t, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS word FROM " + _T


@query("word_counts", f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY 1 HAVING count(*) >= 3")
def word_counts(spark, d):
    return K.word_counts(_ascii(spark, d), X.whitespace_split("t"), 3)


_TRAINED = f"SELECT word AS token, (row_number() OVER (ORDER BY n DESC, word) + 0)::INT AS id FROM (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 499)"


@query("wordlevel_train", f"SELECT '[UNK]' AS token, 0 AS id UNION ALL {_TRAINED}")
def wordlevel_train(spark, d):
    return K.train_wordlevel(_ascii(spark, d), "t", 500, specials=["[UNK]"])


@query("unigram_train", f"SELECT word AS token, round(n / sum(n) OVER (), 12) AS prob FROM (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 300")
def unigram_train(spark, d):
    return K.train_unigram(_ascii(spark, d), "t", 300).select("token", F.round("prob", 12).alias("prob"))


@query("wordlevel_encode", f"WITH v AS (SELECT '[UNK]' AS token, 0 AS id UNION ALL {_TRAINED}), d AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS p FROM {_T}), w AS (SELECT doc_id, unnest(p) AS word, unnest(range(0, len(p))) AS i FROM d), e AS (SELECT doc_id, count(*)::INT AS n, sum(coalesce(id, 0))::BIGINT AS s, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids FROM w LEFT JOIN v ON word = token GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(ids, '') AS ids FROM d LEFT JOIN e USING (doc_id)")
def wordlevel_encode(spark, d):
    """A trained vocabulary is small: each task looks words up in it, nothing is shuffled. A text without words is an empty list."""
    t = _ascii(spark, d)
    vocab = {r["token"]: r["id"] for r in K.train_wordlevel(t, "t", 500, specials=["[UNK]"]).collect()}  # 500 at most
    out = K.lookup_ids(t.select("doc_id", X.whitespace_split("t").alias("w")), "w", vocab, 0, "ids")
    return out.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("pad_truncate", r"SELECT doc_id, len(p)::INT AS n, list_concat(p[1:8], list_transform(range(0, (8 - least(len(p), 8))::BIGINT), lambda i: '[PAD]')) AS p, list_concat(list_transform(p[1:8], lambda x: 1), list_transform(range(0, (8 - least(len(p), 8))::BIGINT), lambda i: 0)) AS mask FROM (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS p FROM " + _T + ")")
def pad_truncate(spark, d):
    t = _ascii(spark, d).select("doc_id", X.whitespace_split("t").alias("w"))
    kept = F.slice("w", 1, 8)
    room = 8 - F.size(kept)
    return t.select("doc_id", F.size("w").alias("n"), F.concat(kept, F.array_repeat(F.lit("[PAD]"), room)).alias("p"), F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), room)).alias("mask"))


def _toy():
    vocab = {t: i for i, t in enumerate(["h", "e", "l", "o", "ll", "he", "llo", "hello"])}
    return K.BPE(vocab, [("l", "l"), ("ll", "o"), ("h", "e"), ("he", "llo")])


@query("bpe_toy", "SELECT 'hello' AS t, [7] AS ids UNION ALL SELECT 'hell', [5, 4] UNION ALL SELECT 'oh', [3, 0]")
def bpe_toy(spark, d):
    t = spark.createDataFrame([("hello",), ("hell",), ("oh",)], "t string")
    return t.select("t", K.Tokenizer(_toy()).encode_ids("t").alias("ids"))


@query("wordpiece_encode", "SELECT 'playing' AS t, ['play', '##ing'] AS tokens, [4, 5] AS ids UNION ALL SELECT 'unplayed', ['[UNK]'], [0] UNION ALL SELECT 'zebra', ['[UNK]'], [0]")
def wordpiece_encode(spark, d):
    vocab = {t: i for i, t in enumerate(["[UNK]", "un", "##able", "##happy", "play", "##ing", "##ed"])}
    tok = K.Tokenizer(K.WordPiece(vocab), pre=X.whitespace_split)
    t = spark.createDataFrame([("playing",), ("unplayed",), ("zebra",)], "t string").withColumn("e", tok.encode("t"))
    return t.select("t", "e.tokens", "e.ids")


@query("turn_tokens", r"SELECT role, count(*) AS turns, sum(len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\w+|[^\w\s]+')))::BIGINT AS tokens FROM conversations GROUP BY 1")
def turn_tokens(spark, d):
    t = table(spark, d, "conversations").select("role", F.size(X.whitespace(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("n"))
    return t.groupBy("role").agg(F.count("*").alias("turns"), F.sum("n").cast("long").alias("tokens"))


@query("document_order_index", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM documents")
def document_order_index(spark, d):
    return ordered.with_row_index(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], "i").select("doc_id", "i")


@query("text_nfc_strip_accents_whole", "SELECT doc_id, strip_accents(text) AS t FROM documents")
def text_nfc_strip_accents_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfc(X.strip_accents("text")).alias("t"))


@query("bpe_round_trip_whole", f"SELECT doc_id, regexp_replace(t, '[ \\t\\n\\r\\f\\v]', '', 'g') AS t FROM {_T}")
def bpe_round_trip_whole(spark, d):
    """A trained vocabulary decodes what it has encoded, but for the blanks that were split at."""
    t = _ascii(spark, d)
    tok = K.Tokenizer(K.train_bpe(t, F.regexp_replace("t", r"\s+", " "), 400), pre=X.whitespace_split)
    return t.select("doc_id", tok.encode_ids("t").alias("ids")).select("doc_id", tok.decode("ids").alias("t"))


@query("byte_level_round_trip_whole", "SELECT doc_id, CASE WHEN starts_with(text, ' ') OR text = '' THEN text ELSE concat(' ', text) END AS t FROM documents")
def byte_level_round_trip_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", X.byte_level_decode(F.array_join(X.byte_level("text"), "")).alias("t"))


@query("token_positions_whole", f"SELECT doc_id, unnest(range(0, len(p)))::BIGINT AS i, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(t, '\\w+|[^\\w\\s]+') AS p FROM {_T})")
def token_positions_whole(spark, d):
    """The pieces, cut from the text at their own offsets."""
    spans = _ascii(spark, d).select("doc_id", "t", X.with_offsets("t", X.whitespace("t")).alias("s"))
    pieces = spans.select("doc_id", F.posexplode(X.cut("t", F.col("s"))).alias("i", "piece"))
    return pieces.select("doc_id", F.col("i").cast("long").alias("i"), "piece")
