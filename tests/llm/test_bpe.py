import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from maskloom.llm import bpe
from maskloom.llm.queries import op12_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(codec):
    ranks = {t: i for i, t in enumerate(codec.tokens)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)


def random_text(r):
    letters = r.choice(["ahbn", "aaaabbc  '  \n\tst rellé1234..!?✓ 的-—aAaAhahahaa", "'sre tvmld", " \n\t a"])
    return "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 40, 300])))


def test_codec_against_tiktoken(codec, plain):
    r = random.Random(5)
    for _ in range(800):
        text = random_text(r)
        assert list(codec.encode(text)) == plain.encode_ordinary(text)
    for text in ("a" * 5000, "ha" * 3000 + "n", " " * 3000 + "x", "<|endoftext|>", "🙂" * 700, "\x00\x01"):
        assert list(codec.encode(text)) == plain.encode_ordinary(text)


def test_long_texts_in_stretches(codec, plain, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "STRETCH", 3)
    text = "don't  stop\n\n now, it's 12345 o'clock  " * 20
    assert list(codec.encode(text)) == plain.encode_ordinary(text)


def test_exactly_one_last_token(codec):
    """Of the tokens that end a prefix, the table's is the only one that may stand there."""
    piece = b" understanding banana unhahaha"
    last, _ = codec.last_tokens(piece)
    for end in range(1, len(piece) + 1):
        fits = [t for n in range(1, end + 1) if (t := codec.ids.get(piece[end - n : end])) is not None and (n == end or codec.may_follow(last[end - n - 1], t))]
        assert fits == [last[end - 1]]


def test_appends_and_edits_equal_a_new_table(codec):
    r = random.Random(6)
    for _ in range(800):
        text, put = random_text(r), random_text(r)[:7]
        at, removed = r.randint(-2, len(text) + 2), r.choice([0, 0, 1, 3, 60])
        new, state, _ = codec.edited(text, codec.table(text), at, removed, put)
        assert state == codec.table(new)
        new, state, _ = codec.edited(text, codec.table(text), len(text), 0, put)
        assert new == text + put and state == codec.table(new)


def test_edits_cost_no_more_than_their_neighbourhood(codec):
    text = "The cat sat on the mat. " * 2000
    _, _, computed = codec.edited(text, codec.table(text), 24_000, 3, "dog")
    assert computed < 40
    one_piece = "banana" * 4000
    _, _, computed = codec.edited(one_piece, codec.table(one_piece), 12_000, 1, "")
    assert computed <= 3 * codec.longest
    _, _, computed = codec.edited(one_piece, codec.table(one_piece), len(one_piece), 0, "nana")
    assert computed == 4


def test_tables(spark, vocabulary, plain):
    texts = [(1, "Hello  world's end"), (2, None), (3, ""), (None, "x" * 500), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(d, t, "mine", 7) for d, t in texts], "doc_id long, text string, tokens string, DECODED int").repartition(3)
    out = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "tokens_", "DECODED_", "tokens", "decoded"]
    got = sorted((repr(r.doc_id), r.tokens, bytes(r.decoded), r.tokens_, r.DECODED_) for r in out.collect())
    assert got == sorted((repr(d), plain.encode_ordinary(t or ""), (t or "").encode(), "mine", 7) for d, t in texts)
    assert bpe.round_trip_digest(docs.limit(0), vocabulary).count() == 0
    states = bpe.prefix_table(docs.select("doc_id", "text"), vocabulary)
    assert sorted(map(repr, (r.tokens for r in bpe.state_tokens(states, vocabulary).collect()))) == sorted(repr(plain.encode_ordinary(t or "")) for _, t in texts)
    edits = spark.createDataFrame([(1, 5, 1, ", dear"), (2, None, None, "now a text"), (3, None, None, None), (4, 0, 99, "")], "doc_id long, at int, removed int, inserted string")
    done = bpe.re_encode(states, edits, vocabulary)
    new = bpe.state_tokens(done, vocabulary)
    want = {1: "Hello, dear world's end", 2: "now a text", 3: "", None: "x" * 500, 4: ""}
    assert sorted((repr(r.doc_id), r.text, r.tokens) for r in new.collect()) == sorted((repr(d), want[d], plain.encode_ordinary(want[d])) for d, _ in texts)


def test_query_against_tiktoken(spark, sf, plain):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = sorted((d.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(d.text.encode())) for d in docs for ids in [plain.encode_ordinary(d.text)])
    assert sorted(tuple(r) for r in op12_byte_bpe(spark, sf).collect()) == want
