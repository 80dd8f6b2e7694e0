import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import no_documents, odd_documents

from callweave.llm import bpe, queries


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cutting_and_merging_equal_the_library(ranks, library):
    rng, cut = random.Random(1), bpe.Splitter(public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice("abcdefgeeethn  \n\t'sé中文😀1234.,!    \r\x85\x1c\u3000") for _ in range(rng.randint(0, 40)))
        pieces = cut(text)
        words = pieces[0] if pieces and isinstance(pieces[0], list) else [w for run in pieces for w in cut.cut(run)]
        assert [i for w in words for i in bpe.encode_word(w.encode(), ranks)] == library.encode_ordinary(text)


def check(docs, rows, library):
    want = []
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_odd_documents_in_small_blocks(spark, ranks, library, monkeypatch):
    docs = odd_documents(spark)
    check(docs, bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect(), library)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 5)
    check(docs, bpe.token_digests(docs, ranks, public_tokenizers.PATTERN).collect(), library)
    assert bpe.token_digests(no_documents(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_decoding_gives_the_text_back(spark, ranks):
    docs = odd_documents(spark).where("doc_id <> 4")
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}


def test_query_equals_the_library(spark, sf_dir, library):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op10_byte_bpe(spark, sf_dir).collect(), library)
