"""Token operators against the libraries they must equal."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from huntlake.llm import bpe
from huntlake.llm.queries import QUERIES
from huntlake.llm.token_counts import token_counts

TEXTS = [
    "a\x1cb c", "  x<|endoftext|>y foo ", "ÀÉ ﬁ Σας ΟΔΟΣ", " two  spaces\n\nnew\tline\n x", "ab½³Ⅷ 12 345", "don't I'LL we're 's",
    " ", "  ", "\n", "　ideo nb", "😀 emoji 👨‍👩‍👧", "é ́x", "", "a" * 20_000, "日本語 \U00031350\U0001E4D0a՘b",
    "x \n y", "tab\t z", "foo.\nBar baz \n\n  q", "<|startoftext|> <|END|>", "İstanbul ıI ǅ", "﻿bom", "w​x\u0085d",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS)) + [(7, "same id"), (100, "twice"), (100, "twice"), (101, None), (None, "no id")]
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int"), rows


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_bytes", [10, bpe.BLOCK_BYTES])
def test_encode_equals_library(texts, ranks, reference, block_bytes):
    df, rows = texts
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(df, ranks, public_tokenizers.PATTERN, block_bytes).collect()), key=repr)
    assert got == sorted(((i, reference.encode_ordinary(t or "")) for i, t in rows), key=repr)


def test_round_trip(texts, ranks):
    df, rows = texts
    got = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted((bytes(r.decoded) for r in got)) == sorted((t or "").encode() for _, t in rows)


def test_round_trip_in_one_task(texts, ranks):
    """Encoding and decoding in one task gives what the two operators give, and the query has no Python step behind it."""
    df, rows = texts
    apart = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect()
    together = bpe.encode_and_decode(df, ranks, public_tokenizers.PATTERN, 10)
    assert sorted(map(tuple, together.collect()), key=repr) == sorted(map(tuple, apart), key=repr)


def test_no_worker_beside_the_assembling_one(spark, sf):
    plan = QUERIES["op2_byte_bpe"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[:plan.index("FlatMapCoGroupsInArrow")]


def test_packed_ids(spark, texts, ranks, reference):
    """Packed ids are small, come through a join, and are unpacked and checked after it; a changed text is noticed."""
    df, rows = texts
    packed = bpe.encode(df, ranks, public_tokenizers.PATTERN, digest=True, packed=True)
    other = spark.createDataFrame([(i, 10 * i) for i in range(len(TEXTS))], "doc_id long, turn long")
    got = bpe.with_round_trip(packed.join(other, "doc_id", "left"), ranks).collect()
    want = [(i, reference.encode_ordinary(t or ""), 10 * i if i is not None and i < len(TEXTS) else None) for i, t in rows]
    assert sorted(((r.doc_id, list(r.ids), r.turn) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.intact and r.n_tokens == len(r.ids) for r in got)
    assert not any(r.intact for r in bpe.with_round_trip(packed.withColumn("text_sha256", F.lit("0")), ranks).collect())
    long = spark.createDataFrame([(1, " ".join(TEXTS) * 50)], "doc_id long, text string")
    row = bpe.encode(long, ranks, public_tokenizers.PATTERN, packed=True).first()
    assert len(row.ids) < len(reference.encode_ordinary(" ".join(TEXTS) * 50))


def test_pipeline_shuffles_packed_ids(spark, sf, ranks):
    """No shuffle of the last stage carries arrays of ids; before, its join did."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = corpus_pipeline.encode_texts(spark, docs, sf)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow checked") < plan.index("Join LeftOuter")
    got = {r.doc_id: r for r in coded.collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in docs.collect():
        assert list(got[d.doc_id].ids) == library.encode_ordinary(d.text or "") and got[d.doc_id].intact


def test_listed_pattern(reference):
    """``re`` cuts every character up to U+FFFF as the library does, alone and among others; other patterns are left to ``regex``."""
    odd = bpe.odd_characters()
    quick = bpe.listed(public_tokenizers.PATTERN, odd)
    cut = bpe.Splitter(public_tokenizers.PATTERN, odd, quick)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    common = list("ab Z19 \n\t'.,sdtm \x1c\x85\xa0")
    texts = TEXTS + ["".join(every), " ".join(every), "a".join(every), "1".join(every)]
    texts += ["".join(rng.choices(every + common * 5000, k=rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(rng.choices(common, k=rng.randrange(40))) for _ in range(2000)]
    old = bpe.Splitter(public_tokenizers.PATTERN, odd)
    for x in texts:
        assert cut.whole(x) == old.whole(x)
    for x in texts[:len(TEXTS)] + texts[-50:]:
        assert [t for w in cut.whole(x) for t in reference.encode_ordinary(w)] == reference.encode_ordinary(x)
    for pattern in (r"\d+", r"\p{Lu}+", r"(?i:x)", r"[[:alpha:]]+", r"[\S]+", r"\w"):
        assert bpe.listed(pattern, odd) is None
    assert bpe.listed(r"ab|c+", odd) == "ab|c+"


def test_packing():
    for values in ([], [0], [254, 255, 256], [70_000, 3, 1 << 20], list(range(1000))):
        a = np.array(values, np.uint32)
        assert bpe.unpacked(bpe.packed(a)).tolist() == values


def test_encode_query(spark, sf, reference):
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_counts_equal_library(texts, spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df, rows = texts
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, path).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted(want, key=repr)
    for r in QUERIES["op7_token_counts"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 2048)


def test_empty_table(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert token_counts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
