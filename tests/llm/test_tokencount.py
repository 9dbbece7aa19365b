"""Token counts against the library on whole texts, and the defined results of odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, tokencount

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.COUNTED_BY))


def prose(rnd, n, letters="abcdefghij"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n))


def odd_texts(seed):
    rnd = random.Random(seed)
    special = "<|endoftext|>"
    return [
        None, "", " ", "word", special, special * 40, "a" * 5000, " " * 3000, "\n" * 1500 + "x", "été \U0001f600 " * 400, "日本語テキスト" * 300, "don't we're 'll " * 200,
        "".join(rnd.choice([special, "<|endo", "ftext|>", " ", "!", "a", "'s", "\n"]) for _ in range(900)), prose(rnd, 900), prose(rnd, 400, "äöü՘\U00018d80ab"),
        prose(rnd, 100) + "z" * 2500 + prose(rnd, 200) + " " * 700 + "q" * 900, " 　\xa0 " * 200, "1234567890" * 200, "".join(rnd.choice(" \n\ta!") for _ in range(4000)),
        "\x00\x1c\x85" * 300, prose(rnd, 300) + special + "b" * 600 + special + prose(rnd, 5),
    ]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 9), (200, 40), (64, 30), (1000, 100)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    texts = odd_texts(chunk)
    rows = [(k, t) for k, t in enumerate(texts)] + [(13, texts[13]), (None, texts[15])]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("taken")).withColumn("key", F.lit(1)).repartition(3)
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(df, *queries.tokenizer_file(), chunk=chunk, overlap=overlap).collect()))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((str(i), len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_pieces_are_the_librarys_for_every_plain_character(library):
    import regex

    source, pattern = queries.tokenizer_file()
    tool = tokencount.Counts(source, pattern)
    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not tool.odd.match(c)]
    assert len(plain) > 30_000 and regex.compile(tokencount.PLAIN).match("՘")
    for at in range(0, len(plain), 500):
        text = "".join(f"a{c}a1{c}1!{c}! {c}  {c}" for c in plain[at : at + 500])
        assert [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in tool.pieces.finditer(text)]


def test_starts_are_of_pieces_on_both_paths():
    tool = tokencount.Counts(*queries.tokenizer_file())
    for text in odd_texts(3):
        if text and tool._plain(text):
            fast = tool.starts(text)
            tool._plain = lambda _: False
            slow = tool.starts(text)
            del tool._plain
            assert fast[0].tolist() == slow[0].tolist() and fast[1].tolist() == slow[1].tolist()


def test_tokenizers_that_give_no_proof_encode_whole_texts(spark, library):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        source = file.read()
    other = Tokenizer.from_str(source)
    rows = [(1, prose(random.Random(1), 900)), (2, "A  b\n" * 300), (3, None)]
    got = {r.doc_id: r.n_tokens for r in tokencount.count(spark.createDataFrame(rows, DOCS), source, "", chunk=100, overlap=30).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False)) for i, t in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert tokencount.count(df, *queries.tokenizer_file()).collect() == []
    with pytest.raises(ValueError):
        tokencount.count(df, *queries.tokenizer_file(), chunk=10, overlap=10)
