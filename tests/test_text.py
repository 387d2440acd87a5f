import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import merges as M
from brindle.functions import text as X
from brindle.functions import tokenizers as K


def first(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "make", "want"),
    [
        ("Hi, you_there!", X.whitespace, ["Hi", ",", "you_there", "!"]),
        (" a  b\tc ", X.whitespace_split, ["a", "b", "c"]),
        ("ab12c3", X.digits, ["ab", "12", "c", "3"]),
        ("ab12", lambda c: X.digits(c, True), ["ab", "1", "2"]),
        ("abcdefg", lambda c: X.fixed_length(c, 3), ["abc", "def", "g"]),
        ("abc", lambda c: X.fixed_length(c, 0), []),
        ("a,b,,c", lambda c: X.char_delimiter(c, ","), ["a", "b", "c"]),
        ("hey!!you", X.punctuation, ["hey", "!", "!", "you"]),
        ("hey!!you", lambda c: X.punctuation(c, "contiguous"), ["hey", "!!", "you"]),
        ("hey!you", lambda c: X.punctuation(c, "merged_with_previous"), ["hey!", "you"]),
        ("hey!you", lambda c: X.punctuation(c, "merged_with_next"), ["hey", "!you"]),
        ("hey!you", lambda c: X.punctuation(c, "removed"), ["hey", "you"]),
        ("Hey you", X.metaspace, ["_Hey", "_you"]),
        ("don't stop", X.bert_pieces, ["don", "'", "t", "stop"]),
        ("abc абв", X.unicode_scripts, ["abc", "абв"]),
    ],
)
def test_pieces(spark, text, make, want):
    assert first(spark, text, make("t")) == want


def test_normalisers(spark):
    assert first(spark, "Straße", X.lowercase("t")) == "strasse"
    assert first(spark, "Café", X.bert_normalize("t")) == "cafe"
    assert first(spark, "  x ", X.strip("t")) == "x"
    assert first(spark, "", X.prepend("t", ">")) == "" and first(spark, None, X.nfc("t")) is None
    assert first(spark, "é☃", X.byte_level_decode(X.byte_level_normalize("t"))) == "é☃"


def test_offsets(spark):
    got = first(spark, "aa b aa", X.with_offsets("t", X.whitespace_split("t")))
    assert [(s["piece"], s["start"], s["end"]) for s in got] == [("aa", 0, 2), ("b", 3, 4), ("aa", 5, 7)]


def test_bpe_and_wordpiece():
    bpe = K.BPE({t: i for i, t in enumerate(["h", "e", "l", "o", "ll", "he", "llo", "hello"])}, [("l", "l"), ("ll", "o"), ("h", "e"), ("he", "llo")])
    assert [p[0] for p in bpe.tokenize("hello")] == [7] and [p[1] for p in bpe.tokenize("hell")] == ["he", "ll"]
    wp = K.WordPiece({t: i for i, t in enumerate(["[UNK]", "hello", "##s"])})
    assert [p[1] for p in wp.tokenize("hellos")] == ["hello", "##s"] and [p[1] for p in wp.tokenize("world")] == ["[UNK]"]
    assert [p[1:] for p in K.Unigram([("<unk>", 0.0), ("ab", 0.5), ("a", 0.5)]).tokenize("aba c")] == [("ab", 0, 2), ("a", 2, 3), ("c", 4, 5)]
    words = K.WordLevel({"a": 0})
    assert words.add_tokens(["a", "b"]) == 1 and words.vocab["b"] == 2 and words.tokenize("z") == []


def test_bpe_matches_a_plain_merger():
    counts = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    vocab, merges = K.merges_of(counts, 30)
    words = {w: list(w) for w in counts}
    plain = []
    while len({c for w in counts for c in w}) + len(plain) < 30:
        pairs = {}
        for w, s in words.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + counts[w]
        best = min(((-n, p) for p, n in pairs.items() if n >= 2), default=None)
        if best is None:
            break
        plain.append(best[1])
        for w, s in words.items():
            out = []
            for c in s:
                if out and (out[-1], c) == best[1]:
                    out[-1] += c
                else:
                    out.append(c)
            words[w] = out
    assert merges[: len(plain)] == plain[: len(merges)]
    bpe = K.BPE(vocab, merges)
    assert "".join(p[1] for p in bpe.tokenize("lowest")) == "lowest"


def test_encoding_with_template_truncation_padding(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c"])}
    tok = K.Tokenizer(K.WordLevel(vocab), pre=X.whitespace_split, template=K.bert_template(), specials={t: vocab[t] for t in ("[PAD]", "[CLS]", "[SEP]")}, pad="[PAD]")
    t = spark.createDataFrame([("a b", "c"), ("a z", None), (None, "c")], "t string, u string")
    got = [r["e"] for r in t.select(tok.encode("t", pad_to=6).alias("e")).collect()]
    assert got[0]["ids"] == [2, 4, 5, 3, 0, 0] and got[0]["attention_mask"] == [1, 1, 1, 1, 0, 0] and got[0]["special_mask"] == [1, 0, 0, 1, 1, 1]
    assert got[1]["ids"][:4] == [2, 4, 1, 3] and got[0]["word_ids"] == [None, 0, 1, None, None, None]
    pair = t.where("u is not null").select(tok.encode("t", "u").alias("e")).first()["e"]
    assert pair["ids"] == [2, 4, 5, 3, 6, 3] and pair["type_ids"] == [0, 0, 0, 0, 1, 1]
    assert tok.encode_pieces(["a", "b", "c"], truncate=3, direction="left").ids == [5, 6, 3]
    assert t.select(tok.decode(F.array(F.lit(2), F.lit(4), F.lit(99), F.lit(5)), True)).first()[0] == "a b"
    again = K.Tokenizer.from_json(tok.to_json(), pre=X.whitespace_split)
    assert again.encode_pieces(["a"]).ids == tok.encode_pieces(["a"]).ids
    e = tok.encode_pieces(list("aabbc"), add_special=False)
    kept, rest = e.truncated(2)
    assert kept.tokens == ["a", "a"] and [r.tokens for r in rest] == [["b", "b"], ["c"]]


def test_decoders():
    assert K.decode_wordpiece()(["play", "##ing", "now"]) == "playing now"
    assert K.decode_ctc()(["a", "a", "<pad>", "b", "|", "c"]) == "ab c"
    assert K.decode_byte_fallback(["<0xC3>", "<0xA9>", "x"]) == "éx"
    assert K.decode_bpe()(["hel", "lo</w>", "you</w>"]) == "hello you"
    assert K.decode_metaspace()(["_a", "_b"]) == "a b"


def test_training(spark):
    t = spark.createDataFrame([("a a b",), ("a c b",), (None,)], "t string")
    assert [(r[0], r[1]) for r in K.train_wordlevel(t, "t", 3, specials=["[UNK]"]).orderBy("id").collect()] == [("[UNK]", 0), ("a", 1), ("b", 2)]
    assert {r["token"]: round(r["prob"], 6) for r in K.train_unigram(t, "t", 2).collect()} == {"a": 0.5, "b": 0.333333}
    assert "##b" not in K.train_wordpiece(t, "t", 10).vocab


def test_offsets_of_a_long_text_take_one_pass(spark):
    text = "é𝒳 word, " * 40_000
    began = time.monotonic()
    t = spark.createDataFrame([(text,), (None,), ("",)], "t string").select("t", X.with_offsets("t", X.whitespace("t")).alias("s"))
    rows = t.select(F.size("s").alias("n"), F.try_element_at("s", F.lit(-1)).alias("last"), X.cut("t", F.col("s")).alias("p")).collect()
    assert time.monotonic() - began < 60  # by locate and append: minutes
    assert rows[0]["n"] == 120_000 and rows[0]["p"] == ["é𝒳", "word", ","] * 40_000 and tuple(rows[0]["last"]) == (",", 9 * 40_000 - 2, 9 * 40_000 - 1)
    assert rows[1]["p"] is None and rows[2]["p"] == []


@pytest.mark.parametrize(("options", "lower"), [({}, 2), ({"prefix": "##", "specials": ["[UNK]"]}, 8)])
def test_merges_from_a_table_are_those_of_the_words_at_once(spark, options, lower):
    draw = random.Random(3)
    words = {"".join(draw.choice("aaabbcdé𝒳") for _ in range(draw.randint(1, 9))): draw.randint(1, 30) for _ in range(300)}
    vocab, found = K.merges_of(words, 40, **options)
    got = M.merges_of_table(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), 40, lower=lower, **options)
    assert got[1] == found and list(got[0].items()) == list(vocab.items()) and len(found) > 15


def test_many_words_are_not_collected(spark, monkeypatch):
    t = spark.createDataFrame([("ab abc abc ab b",), ("abd ab",)], "t string")
    want = K.train_bpe(t, "t", 7)
    monkeypatch.setattr(K, "DRIVER_WORDS", 2)
    monkeypatch.setattr(K, "merges_of", None)  # the way that needs all words on the driver
    got = K.train_bpe(t, "t", 7)
    assert (got.vocab, got.merges) == (want.vocab, want.merges) and want.merges
    tok = K.Tokenizer(got, pre=X.whitespace_split)
    rows = t.unionByName(spark.createDataFrame([(None,), ("",), ("zab  b",)], "t string")).select(tok.encode_ids("t").alias("i")).select("i", tok.decode("i").alias("t")).collect()
    assert [r["t"] for r in rows] == ["ababcabcabb", "abdab", None, "", "abb"] and rows[2]["i"] is None
    assert rows[0]["i"] == [i for w in "ab abc abc ab b".split() for i, *_ in got.tokenize(w)]
