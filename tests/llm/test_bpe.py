import hashlib
import random

import numpy as np
import pytest
import tiktoken

import public_tokenizers
from tokenizers import Tokenizer
from vintara.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.vocabulary(PATH).rank
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings(n, seed=0):
    rng = random.Random(seed)
    alphabets = ["abcdefghij", "aab", "thein ", "éàñ漢字🙂", "\x00\x7f\x85", ".!?#'", "   \n\t\r", "0123²", "İſK  "]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 40)))


def test_ids_are_those_of_the_library(reference):
    memo = bpe.table_memo(PATH)
    for text in strings(3000):
        ids = np.frombuffer(memo.ids(text), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert bpe.decode(ids, PATH).decode() == text


def test_both_vocabulary_files_agree():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    memo = tokens.library_memo(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*strings(2000, 1), "<|endoftext|> x"]:
        assert np.frombuffer(memo.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_appends_and_edits_are_exact(reference):
    v, rng = bpe.vocabulary(PATH), random.Random(5)
    for text in strings(200, 2):
        table, data = bpe.PrefixTable(v), b""
        for part in (text[:3], text[3:10], text[10:]):
            table.append(part.encode())
            data += part.encode()
            assert table.ids() == (reference._encode_single_piece(data) if data else [])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        table.edit(a, b, b"xyz")
        assert table.ids() == reference._encode_single_piece(data[:a] + b"xyz" + data[b:])


def test_a_full_memo_starts_anew():
    memo = tokens.WordMemo(lambda word: [len(word)], limit=2)
    assert np.frombuffer(memo.ids("a bb ccc dddd a"), "<u4").tolist() == [1, 3, 4, 5, 2]


def test_rows_of_every_kind(spark, reference):
    texts = [(1, None), (2, ""), (None, "word"), (3, "a" * 3000), (3, "a" * 3000), (4, "don't  stop\n\n")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_tokens int")
    got = bpe.encode_round_trip(docs).collect()
    want = []
    for doc_id, text in texts:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_round_trip(docs.limit(0)).count() == 0


def test_table(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_round_trip(docs).collect():
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_long_words_are_not_remembered():
    from vintara.llm.tokens import MEMO_CHARS, WordMemo

    memo = WordMemo(lambda word: [len(word)], limit=3)
    long = "x" * (MEMO_CHARS + 1)
    assert memo[long] == (len(long)).to_bytes(4, "little") and long not in memo
    for word in ("a", "bb", "ccc", "dddd"):
        assert memo[word] == len(word).to_bytes(4, "little")
    assert set(memo) == {"dddd"}
