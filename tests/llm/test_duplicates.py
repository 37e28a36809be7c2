import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from kvlake.llm import jaccard_join
from kvlake.llm.components import components
from kvlake.llm.embedding_dedup import links_between, op9_embedding_dedup
from kvlake.llm.jaccard_join import FRAGMENTS, Join, Order, count_order, op8_jaccard_join, overlap, packed, packed_small, parity, segments, unpacked_small
from kvlake.llm.shingles import shingle_sets
from kvlake.llm.winnowing import op7_fingerprints


def roots(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_classes(texts, n, num, den):
    sets = [shingles(t, n) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return {i: (len(sets[i]), r) for i, r in enumerate(roots(len(texts), pairs))}


@pytest.fixture(scope="module")
def copies(odd_texts):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(draw.choice(words) for _ in range(40))
    texts = list(odd_texts)
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randrange(5, 120))]
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 20)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [f"{common} {draw.choice(words)} {draw.choice(words)}" for _ in range(40)]  # a hot passage, some of them alike
    texts += [" ".join([*common.split(), *(draw.choice(words) for _ in range(30))]) for _ in range(30)]
    return texts


@pytest.mark.parametrize("few", [24, 2])
@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_classes(monkeypatch, make_docs, copies, few, n, num):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    found = {r["id"]: (r["n"], r["component"]) for r in Join(make_docs(copies), n, num, 100).run().collect()}
    assert found == brute_classes(copies, n, num, 100)


def test_jaccard_by_join_of_texts(monkeypatch, make_docs, copies):
    monkeypatch.setattr(jaccard_join, "PICKED", 1)
    monkeypatch.setattr(jaccard_join, "SHARED", 1)
    monkeypatch.setattr(jaccard_join, "LOWEST", 1)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    found = {r["id"]: (r["n"], r["component"]) for r in Join(make_docs(copies), 3, 90, 100).run().collect()}
    assert found == brute_classes(copies, 3, 90, 100)


def test_jaccard_query(spark, make_docs, copies, tables):
    rows = op8_jaccard_join(spark, tables(documents=make_docs(copies))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_classes(copies, 3, 90, 100)
    assert op8_jaccard_join(spark, tables(documents=make_docs([]))).count() == 0
    assert op8_jaccard_join(spark, tables(documents=make_docs([None, ""]))).count() == 2


def test_jaccard_moves_fragments_of_open_pairs_only(monkeypatch, make_docs, copies):
    """Beyond the leading fragment either side of the comparison gets the sets of its own nodes of pairs that are still open."""
    seen, partial = [], Join.partial

    def spied(pairs, *cuts):
        if "overlap" in pairs.columns:  # the pairs that the leading fragment leaves open
            open_ = [{r[i] for r in pairs.collect()} for i in "ab"]
            seen.append((open_, [{r["node"] for r in cut.collect()} for cut in cuts]))
        return partial(pairs, *cuts)

    monkeypatch.setattr(Join, "partial", staticmethod(spied))
    found = {r["id"]: (r["n"], r["component"]) for r in Join(make_docs(copies), 3, 90, 100).run().collect()}
    assert found == brute_classes(copies, 3, 90, 100)
    assert seen and seen[0][0][0] and all(len(moved) == 2 and a <= open_[0] and b <= open_[1] for open_, moved in seen for a, b in [moved])


def test_shingle_sets_and_bounds(copies):
    sets = list(shingle_sets(copies, 3))
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in copies]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    order = Order(64, every[counts > 4], (counts[counts > 4] % 60).astype(np.uint8))
    draw = random.Random(2)
    for _ in range(300):
        i, j = draw.randrange(len(sets)), draw.randrange(len(sets))
        a, b = sets[i], sets[j]
        x, y = segments(a, order), segments(b, order)
        assert len(x) == FRAGMENTS and np.array_equal(np.sort(np.concatenate(x)), a)
        both = sum(overlap(p, q) for p, q in zip(x, y))
        assert both == len(shingles(copies[i], 3) & shingles(copies[j], 3))
        assert overlap(x[-1], y[-1]) == len(set(x[-1]) & set(y[-1])) and set(x[-1]) <= set(every[counts > 4])
        # A sketch never differs in more bits than the sets differ in shingles.
        assert np.bitwise_count(parity(a) ^ parity(b)).sum() <= len(a) + len(b) - 2 * both


def test_packing_of_counters():
    draw = np.random.default_rng(6)
    for values in ([], [0], [255], [254, 255, 256, 0xFFFFFF00], draw.integers(0, 600, 2000), draw.integers(0, 2**32, 200)):
        values = np.array(values, dtype=np.uint32)
        assert np.array_equal(unpacked_small(packed_small(values)), values)
    rising = np.unique(draw.integers(0, 1 << 20, 3000).astype(np.uint64))
    assert np.array_equal(np.cumsum(unpacked_small(packed(rising))), rising)


def test_counted_order(monkeypatch, make_docs, copies):
    monkeypatch.setattr(jaccard_join, "HELD", 1000)
    order = count_order(make_docs(copies), 3)
    counts = np.unique(np.concatenate([s >> order.shift for s in shingle_sets(copies, 3)]), return_counts=True)
    want = {int(c): int(4 * np.log2(k)) for c, k in zip(*counts) if k >= jaccard_join.COMMON}
    assert want and dict(zip(order.common.tolist(), order.levels.tolist())) == want
    monkeypatch.setattr(jaccard_join, "MOST", len(want) // 2)
    few = count_order(make_docs(copies), 3)
    assert 0 < len(few.common) <= len(want) // 2 and few.levels.min() > max([v for c, v in want.items() if c not in set(few.common.tolist())])


def test_components(spark):
    draw = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(70)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    truth = roots(300, pairs)
    assert found == {x: truth[x] for p in pairs for x in p if p[0] != p[1]} | {x: truth[x] for x in found}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text, k=8, window=16):
    units = [c.encode("utf-32-be") for c in text]
    grams = [xxhash.xxh64(b"".join(units[i : i + k]), seed=42).intdigest() for i in range(max(len(units) - k + 1, 1))] if units else []
    grams = [g & (1 << 54) - 1 for g in grams]
    order = [g - (1 << 54) if g >> 53 else g for g in grams]
    kept = []
    for j in range(max(len(grams) - window + 1, 1) if grams else 0):
        span = order[j : j + window]
        at = j + max(i for i, g in enumerate(span) if g == min(span))
        if kept[-1:] != [at]:
            kept.append(at)
    return [(p, grams[p]) for p in kept]


def written(prints):
    return ",".join(str(p) for p, _ in prints) + "|" + ",".join(str(h) for _, h in prints)


def alike(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, make_docs, odd_texts, tables):
    import hashlib

    ids = [3 * i - 40 for i in range(len(odd_texts))]
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, tables(documents=make_docs(odd_texts, ids))).collect()}
    assert sorted(rows) == ids
    for i, (doc, text) in enumerate(zip(ids, odd_texts, strict=True)):
        text, after = text or "", odd_texts[(i + 1) % len(ids)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, next_ = brute_print(text), brute_print(edited), brute_print(after)
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == written(own) and r["edited_fingerprint"] == written(changed)
        assert r["near_edited"] == pytest.approx(alike(own, changed)) and r["near_next"] == pytest.approx(alike(own, next_))


@pytest.mark.parametrize("cuts", [(2, 200, 1 << 20), (3, 4, 1 << 20), (1, 8, 40)])
def test_fingerprint_ranges_and_corners(spark, make_docs, tables, monkeypatch, cuts):
    from kvlake.llm import winnowing

    monkeypatch.setattr(winnowing.in_ranges, "__defaults__", cuts)
    texts = [f"text number {i} with a few words {i % 3}" for i in range(300)]
    ids = [i * i * 7 - 1000 for i in range(300)]
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, tables(documents=make_docs(texts, ids))).collect()}
    assert len(rows) == 300
    for i, text in enumerate(texts):
        assert rows[ids[i]]["near_next"] == pytest.approx(alike(brute_print(text), brute_print(texts[(i + 1) % 300])))


def test_fingerprint_corners(spark, make_docs, tables):
    one = op7_fingerprints(spark, tables(documents=make_docs(["alone here"]))).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert op7_fingerprints(spark, tables(documents=make_docs([]))).count() == 0
    assert op7_fingerprints(spark, tables(documents=make_docs(["same", "same", None], [1, 1, None]))).count() == 3


def test_edited_fingerprints(spark, make_docs, tables):
    """Edited texts of all lengths around those at which the parts of a fingerprint change, with ties and repeats."""
    draw = random.Random(12)
    texts = ["".join(draw.choice("ab" if i % 3 else "abcdefghij klmno 😀文") for _ in range(n)) for i, n in enumerate([0, 1, 2, 5, 7, 8, 9, 15, 22, 23, 24, 25, 30, 31, *range(40, 130, 7), 190, 200, 201, 333, 980, 1000, 2100, 3000, 60, 4000, 3, 900, 0, 500] * 2)]
    texts += ["a" * 300, "a" * 700, "ab" * 400, "a" * 50]
    draw.shuffle(texts)
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, tables(documents=make_docs(texts))).collect()}
    for i, text in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(text) // 2
        edited = brute_print(text[: len(text) - half] + after[:half])
        assert rows[i]["edited_fingerprint"] == written(edited), (len(text), len(after))
        assert rows[i]["near_edited"] == pytest.approx(alike(brute_print(text), edited))


def test_fingerprints_are_native(spark, make_docs, tables):
    plan = op7_fingerprints(spark, tables(documents=make_docs(["a b c"])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_grams_are_compiled(spark, make_docs, tables):
    """Hashes and minima stand outside lambdas, which Spark interprets gram by gram, and in no generated method of a whole stage."""
    plan = op7_fingerprints(spark, tables(documents=make_docs(["a b c"])))._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "xxhash64(" in line or "least(_" in line or "array_remove(" in line]
    assert len(steps) >= 3 and not any("lambda" in line or "*(" in line for line in steps)


def test_fingerprint_blocks(spark, make_docs):
    """Texts of lengths around those at which blocks begin and end, with ties, in the operator's own form."""
    from kvlake.llm.winnowing import BLOCK, fingerprint_documents

    draw = random.Random(21)
    texts = ["".join(draw.choice("ab" if i % 2 else "abcdefghij 文") for _ in range(n * BLOCK + d)) for n in (1, 2, 3) for i, d in enumerate((-1, 0, 1, 15, 21, 22, 23, 24, 25))] + ["a" * 3 * BLOCK, "", None]
    rows = {r["doc_id"]: r["prints"] for r in fingerprint_documents(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert list(zip(rows[i]["p"], rows[i]["h"], strict=True)) == brute_print(text or ""), len(text or "")


def test_edited_texts_are_looked_at_near_the_seam_only(spark):
    from kvlake.llm.winnowing import LONG, REACH, seams

    rows = spark.createDataFrame([("x" * (a + b), a, b) for a, b in ((5000, 4000), (5000, LONG - 1), (LONG - 1, 40))], "whole string, _kept int, _taken int")
    found = [(r["_mid_at"], len(r["_mid"]), len(r["_end"])) for r in seams(rows, "whole").collect()]
    assert found == [(5000 - REACH, 2 * REACH, REACH), (5000 - REACH, REACH + LONG - 1, 0), (0, LONG + 39, 0)]


def test_guarantee():
    draw = random.Random(9)
    for _ in range(40):
        shared = "".join(draw.choice("abcdefghijklmnop ") for _ in range(23))
        a, b = ("".join(draw.choice("qrstuvwxyz") for _ in range(draw.randrange(80))) for _ in "ab")
        one, two = (brute_print(x + shared + x) for x in (a, b))
        assert {h for _, h in one} & {h for _, h in two}


def test_short_and_unspaced_texts_match(spark, make_docs, tables):
    draw = random.Random(3)
    run = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(2000))
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 9)))
    texts = [run, f"终{run}", " ".join(word() for _ in range(600))] + [" ".join(word() for _ in range(n)) for n in (12, 18, 25, 37)]
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, tables(documents=make_docs(texts))).collect()}
    # The same passage, shifted by one; then texts of which half is kept.
    assert rows[0]["near_next"] > 0.98
    assert all(rows[i]["near_edited"] > 0.1 for i in range(2, 7))


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 16))
    near = [b + draw.normal(size=16) * s for b in base for s in (0.0, 0.05, 0.1, 0.2)]
    rows = [[float(np.float32(x)) for x in v] for v in near] + [[2 * x for x in map(float, np.float32(base[0]))]]
    return rows + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0], rows[3], rows[3]]


@pytest.mark.parametrize("tile", [4096, 20])
def test_vectors(spark, vectors, tables, tile, monkeypatch):
    from kvlake.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup.near_vectors, "__defaults__", (0.95, "vec_id", "embedding", tile))
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, rep string")
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: (w := np.array(vectors[i], dtype=np.float32).astype(float)) / np.linalg.norm(w) for i in good}
    pairs = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    degree = defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    label = roots(len(vectors), pairs)
    rows = op9_embedding_dedup(spark, tables(embeddings=frame)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == {i: (degree[i], label[i], label[i] == i) for i in range(len(vectors))}
    assert op9_embedding_dedup(spark, tables(embeddings=frame.limit(0))).count() == 0


def test_bounds_lose_nothing():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(60, 1500))
    y = np.concatenate([x + draw.normal(size=x.shape) * 0.33, draw.normal(size=(40, 1500))])
    cosine = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    found = {(int(a), int(b)) for s in links_between(x, y, 0.95) for a, b in zip(*s, strict=True)}
    assert found == set(map(tuple, np.argwhere(cosine >= 0.95)))
