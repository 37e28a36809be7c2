import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kvlake.llm import packing
from kvlake.llm.bpe import Encoder, decode, fold_long, op2_bpe
from kvlake.llm.packing import op10_packing
from kvlake.llm.sharding import lpt, op1_sharding
from kvlake.llm.tokens import encode_ids, ranks_of

RANKS = ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
JSON = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def plain_lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for x in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + x, s))
    return sorted(load for load, _ in heap)


@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 400)), max_size=12, unique_by=lambda c: c[0]), st.integers(1, 9))
@settings(deadline=None)
def test_lpt_equals_one_by_one(classes, shards):
    given_ = lpt([(size, n, float(size)) for size, n in classes], shards)
    assert all(sum(given_[size]) == n for size, n in classes)
    loads = sorted(sum(given_[size][s] * size for size, _ in classes) for s in range(shards))
    assert loads == plain_lpt([size for size, n in classes for _ in range(n)], shards)


def test_shards(spark, make_docs, odd_texts, tables):
    texts = odd_texts + ["a hot text"] * 150
    rows = op1_sharding(spark, tables(documents=make_docs(texts)), 5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    where, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        where[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(len(t.encode()) + 16 for t in texts if (t or "") == g) if False else (len(g.encode()) + 16) * sum((t or "") == g for t in texts) for g in where]
    assert max(loads.values()) <= 1.01 * max(plain_lpt(sizes, 5)) + 16


def test_shards_of_nothing(spark, make_docs, tables):
    assert op1_sharding(spark, tables(documents=make_docs([])), 5).count() == 0


def test_bpe_equals_library(odd_texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own = Encoder(RANKS, P.PATTERN, remembered=50)
    draw = random.Random(3)
    wild = ["".join(chr(draw.choice([32, 10, 39, 97, 115, 0x4E2D, 0x1F600, 0x301, 0x660, 0xA0, 0x85])) for _ in range(200)) for _ in range(60)]
    for text in [t or "" for t in odd_texts] + wild:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert decode(ids, own.pieces) == text.encode()


@given(st.binary(min_size=1, max_size=80))
def test_long_fold_equals_short(word):
    from kvlake.llm.bpe import fold

    if word not in RANKS:
        assert fold(word, RANKS) == fold_long(word, RANKS)


def test_fold_in_sql(spark, odd_texts):
    import regex
    from pyspark.sql import functions as F

    from kvlake.llm.bpe import fold, fold_in_sql, rank_map

    split = regex.compile(P.PATTERN).findall
    words = sorted({w for t in odd_texts for w in split(t or "")[:40]}, key=len)[:150]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold_in_sql(F.col("w"), rank_map(RANKS)).alias("ids")).collect()
    assert len(rows) == len(words) and all(list(r["ids"]) == fold(r["w"].encode(), RANKS) for r in rows)


def test_bpe_query(spark, make_docs, odd_texts, tables):
    own = Encoder(RANKS, P.PATTERN)
    rows = op2_bpe(spark, tables(documents=make_docs(odd_texts))).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        text = odd_texts[r["doc_id"]] or ""
        raw = own.encode(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert op2_bpe(spark, tables(documents=make_docs([]))).count() == 0


@given(st.text(st.characters(max_codepoint=0x24F), max_size=60) | st.text(max_size=30))
@settings(deadline=None)
def test_fast_ids_equal_tokenizer(text):
    exact = Tokenizer.from_file(JSON[0])
    text = text.encode("utf-8", "ignore").decode()
    assert encode_ids(text, *JSON).tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "中<|endoftext|> é <|endoftext|>", "<|endoftext", "plain"])
def test_ids_equal_the_default_tokenizer(text):
    assert encode_ids(text, *JSON).tolist() == Tokenizer.from_file(JSON[0]).encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(deadline=None, max_examples=40)
def test_plan_places_every_piece(lengths):
    demand = np.bincount(lengths, minlength=65)
    plan = packing.plan_sequences(demand, 64)
    used = np.zeros(65, dtype=int)
    for pattern, many in plan:
        assert sum(pattern) <= 64 and many > 0
        for k in pattern:
            used[k] += many
    assert (used == demand).all()
    assert sum(m for _, m in plan) <= 11 / 9 * -(-sum(lengths) // 64) + 4 + sum(x > 32 for x in lengths)


def test_plan_is_near_the_bound():
    draw = np.random.default_rng(5)
    demand = np.bincount(np.minimum(draw.geometric(1 / 300, 200_000), 1024), minlength=1025)
    sequences = sum(m for _, m in packing.plan_sequences(demand, 1024))
    assert sequences <= 1.002 * np.ceil((demand * np.arange(1025)).sum() / 1024)
    # The program itself covers most of the pieces.
    left = demand.copy()
    left[1024] = 0
    assert sum(packing.solve_lp(left, 1024).values()) > 0


def test_packing_query(spark, make_docs, odd_texts, tables):
    exact = Tokenizer.from_file(JSON[0])
    odd_texts = [*odd_texts, "Hello <|endoftext|> world", "<|endoftext|> x", "これは<|endoftext|>です"]
    rows = op10_packing(spark, tables(documents=make_docs(odd_texts))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(odd_texts):
        ids = np.append(exact.encode(text or "", add_special_tokens=False).ids, 2).astype("<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 1024))) and all(r["length"] == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert op10_packing(spark, tables(documents=make_docs([]))).count() == 0
