import base64
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from hrefloom.llm import bpe

from .conftest import rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = bpe.read_ranks(PATH)
RANKS = bpe.parse_ranks(RAW)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_equal_the_library(spark, docs, no_docs, library):
    found = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in found) == sorted((r[0] or 0, library.encode_ordinary(r[1] or "")) for r in rows())
    assert sorted(bytes(r.decoded) for r in found) == sorted((r[1] or "").encode() for r in rows())
    assert bpe.round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_words_by_higher_order_functions(spark, library):
    find = regex.compile(public_tokenizers.PATTERN).findall
    words = sorted({w for r in rows() if len(r[1] or "") < 900 for w in find(r[1] or "")}) + ["", "abcdefgh" * 4]
    table = spark.createDataFrame([(w,) for w in [*words, None]], "word STRING")
    found = {r.word: r.ids for r in bpe.encode_words(table, RAW).collect()}
    assert found.pop(None) is None
    assert {w: list(i) for w, i in found.items()} == {w: list(bpe.fold(w.encode(), RANKS)) if w else [] for w in words}


def test_fold_equals_the_library(library):
    random.seed(4)
    find = regex.compile(public_tokenizers.PATTERN).findall
    alphabet = list("abcdeé  \t\n\r\x0b\x1c\x85 　漢字١२½'st.,!-😀́﻿\x00")
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(2000)]
    texts += ["abcd" * 80, "x" * 500, "hello" * 300, "é" * 300, "qz" * 2000]
    for t in texts:
        assert [i for w in find(t) for i in bpe.fold(w.encode(), RANKS)] == library.encode_ordinary(t)


def test_very_long_word():
    assert b"".join(t for t in [b""]) == b"" and len(bpe.fold(b"ab" * 100_000, RANKS)) > 1000
