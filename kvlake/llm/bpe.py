"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding concatenates binary pieces.

``fold_in_sql`` is the fold in higher-order functions with a literal rank map.  It gives the same ids but takes some
hundred times as long for a word, and its words would have to be joined back to every occurrence (figures in the README),
so the operator folds in Python workers: within a batch each distinct word once; a bounded table keeps words between
batches.

Whole texts are encoded, however long; long words by a heap.  Null texts count as empty and have no ids; the ids of an empty text hash as the empty string.  Repeated rows are
encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map

#: Words that a worker remembers between batches.
REMEMBERED = 400_000


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank merges, leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 256:
        return fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    scores = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while scores and (lowest := min(scores)) < none:
        i = scores.index(lowest)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and a linked list, for words of thousands of bytes."""
    import heapq

    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank_at(i: int):
        j = after[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank_at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, upto = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != upto or rank_at(i) != rank:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank_at(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def rank_map(ranks: dict[bytes, int], buckets: int = 1 << 14) -> Column:
    """The ranks as a literal: hash buckets of (piece in hexadecimal, rank), since lookups in a map literal are linear."""
    import json

    import xxhash

    table: list[list[dict]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        table[xxhash.xxh64_intdigest(piece.hex().encode(), seed=42) % buckets].append({"p": piece.hex(), "r": rank})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<p:string,r:int>>>")


def fold_in_sql(word: Column, table: Column, buckets: int = 1 << 14) -> Column:
    """Ids of a word (not empty) by higher-order functions; ``table`` is rank_map's."""
    let = lambda value, body: F.transform(F.array(value), body)[0]
    find = lambda piece: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(piece), F.lit(buckets)).cast("int")), lambda e: e["p"] == piece), F.lit(0))["r"]

    def merge(parts: Column, ranks: Column) -> Column:
        at = F.array_position(ranks, F.array_min(ranks)).cast("int")
        after = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
        both = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        return F.when(F.array_min(ranks).isNull(), parts).otherwise(F.concat(F.slice(parts, F.lit(1), at - 1), both, after))

    def step(parts: Column, _: Column) -> Column:
        n = F.size(parts) - 1
        pairs = F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), lambda a, b: find(F.concat(a, b)))
        return F.when(n < 1, parts).otherwise(let(pairs, lambda ranks: merge(parts, ranks)))

    whole = F.lower(F.hex(word.cast("binary")))
    single = F.regexp_extract_all(whole, F.lit(".."), F.lit(0))
    folded = F.transform(F.aggregate(F.sequence(F.lit(1), F.size(single)), single, step), find)
    return let(find(whole), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded))


def decode(ids, pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids])


class Encoder:
    """Encodes texts; equal words share one fold."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks, self.split, self.remembered = ranks, regex.compile(pattern).findall, remembered
        self.known: dict[str, bytes] = {}
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            fresh = set(words).difference(known)
        if len(known) + len(fresh) > self.remembered:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = np.array(fold(w.encode(), self.ranks), dtype="<u4").tobytes()
        return b"".join([known[w] for w in words])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every text, with ``keep_ids`` also ids array<long>."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids

    def run(batches):
        import pyarrow as pa

        from kvlake.llm.tokens import ranks_of

        encoder = Encoder(ranks_of(ranks_path), pattern)
        for batch in batches:
            counts, hashes, back, all_ids = [], [], [], []
            for text in batch.column(1):
                raw = encoder.encode(text.as_py() or "")
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                counts.append(len(ids))
                hashes.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decode(ids, encoder.pieces)).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())] + ([pa.array(all_ids, pa.list_(pa.int64()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return arrow_map(docs.select(id_col, text_col), run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from kvlake.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
