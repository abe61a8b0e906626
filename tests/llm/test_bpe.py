from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gleaner.llm import bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "don't we'll 's", "日本語 😀‍👩 é", "a" * 500, "  \t\r\n ", "½²Ⅷ", "x\x00\x1c y", "'", "''s", " 're", "İıſK", "\u0301a", "word" * 300]


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        return bpe.codec_for(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def exact():
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_like_the_library(codec, exact):
    rng = random.Random(1)
    alphabets = ["abcdefgh ", "the ing tion er ", "0123456789.,", "éèàüß ñ", "日本語文字", " \n\t", "'sdtvemrl ", "!?#$%&|"]
    texts = ODD + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == exact.encode_ordinary(text), text


def test_a_frozen_table_gives_the_same(exact):
    with open(VOCABULARY, "rb") as f:
        small = bpe.Codec(bpe.parse_ranks(f.read()), P.PATTERN)
    small.transducer.max_states = 20
    texts = ["unprecedented internationalisation of the vocabulary", "Donaudampfschifffahrt", "x" * 200] * 2
    for text, ids in zip(texts, small.encode_batch(texts), strict=True):
        assert ids.tolist() == exact.encode_ordinary(text)


def test_decoding_streams_over_any_cut(codec):
    for text in ODD:
        ids = codec.encode(text)
        for cut in range(len(ids) + 1):
            assert "".join(codec.decode_stream([ids[:cut], ids[cut:]])) == text


def test_documents(spark, exact):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "x"), (5, ODD[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "1 AS ids", "'q' AS n_tokens")
    got = bpe.encode_documents(df, VOCABULARY, P.PATTERN)
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and found[100].n_tokens == 0
    for i, t in enumerate(ODD):
        assert found[i].ids == exact.encode_ordinary(t)
    back = {r.doc_id: r.text for r in bpe.decode_documents(got, VOCABULARY).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD))
    assert bpe.encode_documents(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_token_table(codec):
    assert codec.token_text(np.zeros(0, np.int64)) == b""
    assert all(codec.token_text(np.array([t])) == b for t, b in list(codec.transducer.token_bytes.items())[::997])


def test_odd_cuts_beside_walked_pieces(exact):
    with open(VOCABULARY, "rb") as f:
        small = bpe.Codec(bpe.parse_ranks(f.read()), P.PATTERN)
    small.transducer.max_states = 20
    assert [a.tolist() for a in small.transducer.run(np.zeros(0, np.uint8), np.zeros(3, np.int64))] == [[], [0, 0, 0]]
    texts = ["", "x" * 200, "", "q", "", "unprecedented " + "y" * 97, ""]
    assert [ids.tolist() for ids in small.encode_batch(texts)] == [exact.encode_ordinary(t) for t in texts]


FREED = """
import random, re
import public_tokenizers as P
from gleaner.llm import bpe, common

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Anonymous:\\s+(\\d+)", f.read())[1]) / 1024

rng = random.Random(1)
words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
    raw = f.read()
before = held()
codec = bpe.codec_for(raw, P.PATTERN, (2000, 3000, 3000))
for _ in range(4):
    codec.encode_batch([" ".join(rng.choices(words, k=200)) for _ in range(1000)])
del codec
common.worker_cache("another operator")
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_that_turns_to_other_work_gives_its_memory_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 20, f"{done.stdout.strip()} MB kept"
