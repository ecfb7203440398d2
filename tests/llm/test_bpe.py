"""BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCABULARY = bpe.Vocabulary(RAW)

HARD = ["", " ", "  ", "a", "'s", " 's", "\n's", "''s", "it's they've I'll 'LL 'x", "'", "'r", "'re", "'rex", "'l", "'ll'll've", "a  b", "a \n b", "\n\n", " \t x  y ", "é'ss ñ12³½ 漢字 🙂🙂 !?!", "x" * 5000, " " * 3000 + "a", "ab" * 2000, "!" * 1000, "<|endoftext|>", "a'b'c'd'm't", "\x1c\x1d\x85z", "؀́é ˜'sʼs"]


def ours(texts):
    return [x.tolist() for x in bpe.Encoder(VOCABULARY).encode(texts)]


def test_hard_texts_as_the_library():
    assert ours(HARD) == [THEIRS.encode_ordinary(t) for t in HARD]


def test_every_code_point_class_as_the_library():
    """The library's own classes, seen by what single-byte ranks keep of a text of all code points."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    classes = bpe.codepoint_classes()
    for kind, pattern in ((bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}"), (bpe.SPACE, r"\s")):
        kept = bytes(tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        assert set(kept) == {c for c in every if classes[ord(c)] == kind}, pattern


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aésl lrevtmd''  \n\t1½!?漢🙂 "))), max_size=6))
def test_mixed_texts_as_the_library(texts):
    assert ours(texts) == [THEIRS.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    assert ours([text]) == [THEIRS.encode_ordinary(text)]


def test_scan_equals_a_loop():
    draw = np.random.default_rng(3)
    functions = draw.integers(0, 256, 10_000).astype(np.uint8)
    state, want = 0, []
    for f in functions.tolist():
        state = (f >> (2 * state)) & 3
        want.append(state)
    assert bpe.scan_states(functions).tolist() == want


def test_long_merges_equal_short_ones():
    draw = np.random.default_rng(1)
    for _ in range(30):
        piece = bytes(draw.choice(list(b"aabcdes "), 250).tolist())
        assert VOCABULARY._merge_long(piece) == VOCABULARY._merge_short(piece)


def test_frames(spark):
    rows = [(i, t, "x", i) for i, t in enumerate([*HARD, None, "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    got = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for (_, text, *_), r in zip(rows, got, strict=True):
        ids = THEIRS.encode_ordinary(text or "")
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == (text or "")
        ends = [*np.frombuffer(r["token_offsets"], "<u4").tolist(), len(r["decoded"])]
        assert [bytes(r["decoded"])[a:b] for a, b in zip(ends, ends[1:], strict=False)] == [THEIRS.decode_single_token_bytes(i) for i in ids]
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.encode(docs.select("text")).select("n_tokens").dtypes == [("n_tokens", "bigint")]


@pytest.mark.parametrize("extra", [{}, {"ranks_path": PATH}])
def test_query(spark, sf_dir, extra):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = THEIRS.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = bpe.op8_bpe(spark, sf_dir) if not extra else bpe.decode(bpe.encode(docs, **extra)).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
