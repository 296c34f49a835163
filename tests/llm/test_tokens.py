from pyspark.sql import functions as F

from tesselith.llm import tokens as T


def test_counts_are_those_of_the_public_vocabulary(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["", "a", "Hello  world\n\n\t x", "<|endoftext|>", "日本語 ünïcode 🙂🙂", "it's we'll 12345 ---", "x" * 30_000, " " * 30_000, None, "\r\n\x00\x1c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["n"] for r in df.select("i", T.token_count(F.col("text")).alias("n")).collect()}
    assert got == {i: None if t is None else len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_pieces_join_to_the_text():
    text = "Grüße 🙂 from the diff --git a/x b/x\n" * 20 + "🙂" * 5
    n = len(T.tokenizer().encode_ordinary(text))
    for size in (1, 3, 50, n):
        pieces = [T.piece_of(text, a, min(n, a + size)) for a in range(0, n, size)]
        assert "".join(pieces) == text


def test_long_white_space():
    enc = T.tokenizer()
    for space in (" ", "\n", "\t ", "\u3000", "\r\n"):
        for n in (9_999, 10_000, 12_000):
            for text in (space * n, "a" + space * n, space * n + "a", "a b" + space * n + "c, d" + space * n + "e", space * n + "." + space * 50 + "7"):
                assert T.tokens_of(enc, text) == enc.encode_ordinary(text)
    for text in (" " * 1_000_000, "a" + " " * 1_000_000 + "b", "x" * 1_000_000):
        assert len(T.tokens_of(enc, text)) > 1000
    assert T.piece_of("a" + " " * 20_000 + "b", 0, 10**6) == "a" + " " * 20_000 + "b"
