import hashlib
import random
import struct

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from sitelens.llm import bpe
from sitelens.llm.queries import op3_bpe

PATH = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library(library):
    random.seed(5)
    parts = [*"aaabbtheing  \n\t'sSé漢字ñ🙂\x1c\x85́!!--__01²٣", "<|endoftext|>", "<|endof", "   \n", "'re", "aaaaaa"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 3000, "!" * 2000, " " * 3000, "", "é" * 999,
              "".join(chr(random.randint(32, 0x2FFF)) for _ in range(9000))]
    encoder = bpe.Encoder(bpe.load(PATH))
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library(text)
        assert encoder.decode(packed) == text


def test_every_token_pair_check_agrees_with_merging():
    vocabulary = bpe.load(PATH)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 50000, (2, 4000))
    x[:1000], y[:1000] = rng.integers(0, 600, (2, 1000))
    good = vocabulary.compatible(x, y)
    for a, b, g in zip(x.tolist(), y.tolist(), good.tolist(), strict=True):
        assert g == (vocabulary.exact(vocabulary.bytes_of[a] + vocabulary.bytes_of[b]) == [a, b])


def test_odd_rows(spark, documents, odd_rows, library):
    got = bpe.encode(documents(odd_rows), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(d), t or "") for d, t in odd_rows)
    for r in got:
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids_le32)) == library(r.decoded)
    assert bpe.encode(documents([]), PATH).collect() == []


def test_query_on_small_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
