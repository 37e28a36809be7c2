"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Two documents link when ``|A n B| / |A u B|`` of their word-shingle sets reaches a ratio, counted exactly.

1. One pass counts shingles by the leading bits of their hash, about one counter for each shingle of the table; cells of
   counters meet in tasks of their own.  Shingles whose counter reaches COMMON are common, at most MOST of them (beyond,
   the commonest).  The global order is: rare shingles by hash, then common ones by the rounded logarithm of the count.
2. The order is cut into FRAGMENTS: ranges of rare shingles, and the common ones as the last.
3. Documents with equal sets are one node.  Two sets that link share a shingle in the first ``n - ceil(t n) + 1`` of
   their order, so these are the keys of candidates.  Common passages stand last and are hardly ever keys.
4. Nodes of a key are compared as pairs where they are few.  In a hot key each node is first compared with PIVOTS of
   them only; then, after components are known, nodes of different components, in blocks.  No pair inside a
   component is emitted.  A candidate pair must fit in size and in a parity sketch, whose differing bits never outnumber
   the differing shingles; both tests only drop pairs that can't link.
5. Sets of candidates are partitioned vertically: a row for each node and fragment.  Overlaps are counted for each pair
   and fragment apart, each from the two segments alone, and summed per pair.  The leading fragment goes first; pairs
   that can't reach the ratio with all that lies beyond it are dropped, the others are counted in the other fragments,
   of which only those of nodes in such pairs are moved, each to the side where its node stands.

Components of the links are found without collecting anything.  Null and blank texts have an empty set and link with
nothing.  Equal texts and repeated rows share a node; of rows that repeat an id with another text each has its own set.
A very long text is one row, and a segment of its set one row of the comparison.
Other columns are never read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map, materialize
from kvlake.llm.components import components
from kvlake.llm.shingles import mix, shingle_sets

#: Count from which a shingle is common, and the number of common shingles that every task is told.
COMMON, MOST = 8, 1 << 19
#: Bits of the counters of one cell, bytes of text for each counter, hashes that a task holds before it counts them.
CELL, BYTES_A_COUNTER, HELD = 20, 8, 1 << 22
#: Fragments of the global order; the last holds the common shingles.
FRAGMENTS = 16
#: Bits of the parity sketch of a set, and of its folded form in the rows of all keys.
PARITY, FOLDED = 1024, 256
#: Nodes of a key up to which all its pairs are compared at once, nodes of a block in hot keys.
FEW, BLOCK = 24, 256
#: Nodes of a hot key with which all its nodes are compared first.
PIVOTS = 6
#: Ids up to which texts are picked by a Bloom filter of BLOOM bits in the scan; beyond, by a join.
PICKED, BLOOM = 1 << 20, 23
#: Shared keys up to which a filter of KEY_BLOOM bits drops the others before they move; beyond, the join does.
SHARED, KEY_BLOOM = 1 << 22, 25
#: Hot keys of a node, the lowest, by which a pair is met at the first key that both share.
LOWEST = 16


def packed(rising: np.ndarray) -> bytes:
    """Rising integers as their steps: one byte each, or 255 and four bytes."""
    steps = np.diff(rising, prepend=rising.dtype.type(0)).astype(np.uint32)
    return packed_small(steps)


def packed_small(values: np.ndarray) -> bytes:
    """Integers below 2^32 of which most are below 255."""
    wide = values >= 255
    ends = np.cumsum(np.where(wide, 5, 1))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends[~wide] - 1] = values[~wide]
    first = ends[wide] - 5
    out[first] = 255
    for i in range(4):
        out[first + 1 + i] = (values[wide] >> np.uint32(8 * i)) & np.uint32(255)
    return out.tobytes()


def unpacked_small(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(raw == 255)
    # Bytes of a wide value can be 255 as well: only marks that lie beyond the value before count.
    marks, upto = [], -1
    for i in at.tolist():
        if i > upto:
            marks.append(i)
            upto = i + 4
    marks = np.array(marks, dtype=np.int64)
    own = np.ones(len(raw), bool)
    for i in range(1, 5):
        own[marks + i] = False
    out = raw.astype(np.uint32)
    out[marks] = sum((raw[marks + 1 + i].astype(np.uint32) << np.uint32(8 * i)) for i in range(4))
    return out[own]


class Order:
    """The global order of shingles: common ones, by the leading ``bits`` of their hash, with their level."""

    def __init__(self, bits: int, common: np.ndarray, levels: np.ndarray):
        self.shift, self.common, self.levels = np.uint64(64 - bits), common, levels

    def level(self, found: np.ndarray) -> np.ndarray:
        """0 for rare shingles, else the rounded logarithm of the count."""
        if not len(self.common):
            return np.zeros(len(found), np.uint8)
        counter = found >> self.shift
        at = np.minimum(np.searchsorted(self.common, counter), len(self.common) - 1)
        return np.where(self.common[at] == counter, self.levels[at], 0).astype(np.uint8)

    def fragment(self, found: np.ndarray) -> np.ndarray:
        """The fragment of every shingle."""
        ranged = ((found >> np.uint64(32)) * np.uint64(FRAGMENTS - 1)) >> np.uint64(32)
        return np.where(self.level(found) > 0, FRAGMENTS - 1, ranged).astype(np.int64)


def counted_cells(sets, bits: int, held: int = HELD):
    """Counts of the leading bits of all hashes, as lists of rows (cell, counters, numbers); ``held`` hashes are counted together.

    They are sorted where they stand and counted cell by cell, so that nothing else of their size is in memory.
    """
    buffer, many = np.empty(held, np.uint64), 0

    def rows():
        values = buffer[:many]
        values.sort()
        cut, ends, at = np.uint64(CELL), [], 0
        while at < many:
            ends.append(at := int(np.searchsorted(values, ((values[at] >> cut) + np.uint64(1)) << cut)))
        out = []
        for a, b in zip([0, *ends], ends, strict=False):
            counters, numbers = np.unique(values[a:b], return_counts=True)
            out.append((int(counters[0] >> cut), packed(counters & np.uint64((1 << CELL) - 1)), packed_small(numbers.astype(np.uint32))))
        return out

    for found in sets:
        while len(found):
            part = found[: held - many]
            buffer[many : many + len(part)] = part >> np.uint64(64 - bits)
            many, found = many + len(part), found[len(part) :]
            if many == held:
                yield rows()
                many = 0
    if many:
        yield rows()


def count_order(docs: DataFrame, n: int, text_col: str = "text") -> Order:
    """Count the shingles of all documents; only the common ones, at most MOST, reach the driver."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(max(CELL, (size // BYTES_A_COUNTER).bit_length()), 56)

    def run(batches):
        import pyarrow as pa

        sets = (found for batch in batches for found in shingle_sets(batch.column(0).to_pylist(), n))
        for rows in counted_cells(sets, bits):
            cell, counters, numbers = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(counters, pa.binary()), pa.array(numbers, pa.binary())], names=["cell", "counters", "numbers"])

    def total(table):
        import pyarrow as pa

        counts = np.zeros(1 << CELL, np.int64)
        for counters, numbers in zip(table.column("counters"), table.column("numbers"), strict=True):
            counts[np.cumsum(unpacked_small(counters.as_buffer()), dtype=np.int64)] += unpacked_small(numbers.as_buffer())
        common = np.flatnonzero(counts >= COMMON)
        cell = table.column("cell")[0].as_py()
        return pa.table({"counter": pa.array(common + (cell << CELL), pa.int64()), "level": pa.array(np.floor(4 * np.log2(counts[common])).astype(np.int32))})

    cells = arrow_map(docs.select(text_col), run, "cell long, counters binary, numbers binary")
    found = materialize(cells.groupBy("cell").applyInArrow(total, "counter long, level int"), "jaccard-common")
    by_level = sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True)
    least, held = 1 << 30, 0
    for level, count in by_level:
        held += count
        if held > MOST:
            break
        least = level
    told = found.where(F.col("level") >= least).toArrow().sort_by("counter")
    return Order(bits, told["counter"].to_numpy().astype(np.uint64), told["level"].to_numpy().astype(np.uint8))


def describe(docs: DataFrame, n: int, num: int, den: int, order: Order, id_col: str, text_col: str) -> DataFrame:
    """For each document: id, n_shingles, two signatures of its set, its candidate keys and its parity sketch."""
    words = PARITY // 64

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, signs, keys, sketches = [], [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), n):
                k = len(found)
                sizes.append(k)
                signs.append((int(mix(found).sum(dtype=np.uint64)), int(mix(found * np.uint64(7)).sum(dtype=np.uint64))))
                keys.append(found[np.argsort(order.level(found), kind="stable")[: k - -(-num * k // den) + 1]] if k else found)
                sketches.append(parity(found).view(np.int64))
            signs = np.array(signs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            sketches = np.array(sketches).reshape(-1, words)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(pa.array(sketches[:, i]) for i in range(words))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "keys", *(f"w{i}" for i in range(words))])

    schema = "id long, n long, s1 long, s2 long, keys array<long>, " + ", ".join(f"w{i} long" for i in range(words))
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, schema)


def parity(found: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Which of ``bits`` (a power of two) the hashes hit an odd number of times, packed in bytes."""
    hits = np.bincount(((found >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little")


def segments(found: np.ndarray, order: Order) -> list[np.ndarray]:
    """The set cut at the fragments of the global order, each segment sorted."""
    at = order.fragment(found)
    sorted_ = found[np.argsort(at, kind="stable")]
    return np.split(sorted_, np.cumsum(np.bincount(at, minlength=FRAGMENTS))[:-1])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common hashes of two segments."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Join:
    """The steps over one table of documents; ``links`` and the classes that ``run`` returns are the results."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.n, self.num, self.den, self.id_col, self.text_col = docs, n, num, den, id_col, text_col
        self.order = count_order(docs, n, text_col)
        self.rows = materialize(describe(docs, n, num, den, self.order, id_col, text_col), "jaccard-rows")
        self.nodes = self.rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("node"))

    def fits(self, sketch: str = "p", bits: int = FOLDED):
        """Conditions on x and y that every pair that links meets."""
        low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        differ = sum((F.bit_count(F.col(f"x.{sketch}{i}").bitwiseXOR(F.col(f"y.{sketch}{i}"))) for i in range(bits // 64)), F.lit(0))
        most = (F.col("x.n") + F.col("y.n")) * (self.den - self.num)
        return (low * self.den >= high * self.num) & (differ * (self.den + self.num) <= most)

    @staticmethod
    def first_met():
        """Whether the key of x and y is the first that both share, as far as their lowest keys tell."""
        return F.coalesce(F.array_min(F.array_intersect("x.low", "y.low")) >= F.col("x.key"), F.lit(True))

    def reaches(self, overlaps):
        """Whether so many common shingles are enough for sets of na and nb."""
        return overlaps * (self.den + self.num) >= (F.col("na") + F.col("nb")) * self.num

    def members(self) -> tuple[DataFrame, DataFrame]:
        """Rows (key, id, n, s1, many) of keys with two nodes or more: few with folded sketches, many with whole ones and low."""
        first = self.nodes.select(F.col("node").alias("id"), "s1", "s2")
        own = materialize(self.rows.join(first, ["id", "s1", "s2"]).drop("s2"), "jaccard-nodes")
        part = FOLDED // 64
        folded = [functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"w{j}") for j in range(i, PARITY // 64, part)]).alias(f"p{i}") for i in range(part)]
        counts = own.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("many"))
        many = materialize(counts.where("many > 1"), "jaccard-keys")
        met = materialize(self.shared_keys(own, many).join(many, "key"), "jaccard-members")
        few = met.where(F.col("many") <= FEW).join(own.select("id", "n", "s1", *folded), "id")
        hot = met.where(F.col("many") > FEW)
        low = hot.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWEST).alias("low"))
        return few, materialize(hot.join(low, "id").join(own.drop("keys"), "id"), "jaccard-hot")

    @staticmethod
    def shared_keys(own: DataFrame, many: DataFrame) -> DataFrame:
        """(key, id) of all keys in ``many``; up to SHARED of them, a Bloom filter drops most others before they move."""
        if many.count() > SHARED:
            return own.select(F.explode("keys").alias("key"), "id")
        at = lambda i: F.shiftrightunsigned("key", 21 * i).bitwiseAND(F.lit((1 << KEY_BLOOM) - 1))
        words = bloom_words(many.select(*[at(i).alias(f"at{i}") for i in range(2)]), KEY_BLOOM)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                lists = batch.column(1)
                keys = lists.flatten().to_numpy().view(np.uint64)
                ids = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
                kept = np.ones(len(keys), dtype=bool)
                for i in range(2):
                    bit = ((keys >> np.uint64(21 * i)) & np.uint64((1 << KEY_BLOOM) - 1)).astype(np.int64)
                    kept &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(ids[kept])], names=["key", "id"])

        return arrow_map(own.select("id", "keys"), run, "key long, id long")

    def fragments_of(self, wanted: DataFrame) -> DataFrame:
        """The vertical partition of the sets of the wanted nodes (column node): node, s1, f, part, lead.

        The leading fragment of a node is a row even where it is empty.  Some nodes that aren't wanted are there as well,
        and other texts of an id; s1 tells texts apart.
        """
        docs = self.docs.select(F.col(self.id_col).cast("long").alias("node"), F.col(self.text_col).alias("_text"))
        words = None
        if wanted.count() > PICKED:
            docs = docs.join(wanted, "node")
        else:
            words = bloom_words(wanted.select(*_places()), BLOOM)
            docs = docs.select("node", "_text", *_places())
        n, order = self.n, self.order

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                batch = batch.filter(pa.array(_hit(words, batch.columns[2:], batch.num_rows)))
                rows = []
                for node, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), n), strict=True):
                    sign = int(mix(found).sum(dtype=np.uint64).view(np.int64))
                    rows += [(node, sign, f, part.tobytes(), f == 0) for f, part in enumerate(segments(found, order)) if f == 0 or len(part)]
                names = ["node", "s1", "f", "part", "lead"]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)))

        return materialize(arrow_map(docs, run, "node long, s1 long, f int, part binary, lead boolean"), "jaccard-fragments", "lead")

    @staticmethod
    def only(cut: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows of ``cut`` of some nodes (column node), picked before they move; of more than PICKED nodes all rows.

        Not by a map in Python: it would stand in one task with that of ``partial``, each with a worker, and workers stay.
        """
        nodes = nodes.distinct()
        return cut if nodes.count() > PICKED else cut.join(F.broadcast(nodes), "node", "left_semi")

    @staticmethod
    def partial(pairs: DataFrame, cut_a: DataFrame, cut_b: DataFrame) -> DataFrame:
        """Of every pair and fragment apart: a, b, overlap and the sizes of both segments, that of a from cut_a, of b from cut_b."""

        def count(batches):
            import pyarrow as pa

            for batch in batches:
                found = [tuple(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in both) for both in zip(batch.column(2), batch.column(3), strict=True)]
                columns = [[overlap(x, y) for x, y in found], [len(x) for x, _ in found], [len(y) for _, y in found]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["a", "b", "overlap", "in_a", "in_b"])

        x, y = (cut.select(F.col("node").alias(i), F.col("s1").alias(f"s{i}"), "f", F.col("part").alias(p)) for cut, i, p in ((cut_a, "a", "x"), (cut_b, "b", "y")))
        return arrow_map(pairs.select("a", "b", "sa", "sb").join(x, ["a", "sa"]).join(y, ["b", "sb", "f"]).select("a", "b", "x", "y"), count, "a long, b long, overlap long, in_a long, in_b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b, na, nb, sa, sb) that link, with their overlap."""
        wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-wanted")
        cut = self.fragments_of(wanted)
        lead, rest = cut.where("lead"), cut.where("not lead").select("node", "s1", "f", "part")
        leading = pairs.join(self.partial(pairs, lead, lead), ["a", "b"])
        beyond = F.least(F.col("na") - F.col("in_a"), F.col("nb") - F.col("in_b"))
        still = materialize(leading.where(self.reaches(F.col("overlap") + beyond)).select(*pairs.columns, "overlap"), "jaccard-open")
        # The bulk of the sets: either side takes those of its own nodes of open pairs.
        sides = [self.only(rest, still.select(F.col(i).alias("node"))) for i in "ab"]
        others = self.partial(still, *sides).select("a", "b", F.lit(0).alias("na"), F.lit(0).alias("nb"), "overlap")
        total = still.select(others.columns).union(others).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("overlap").alias("overlap"))
        return materialize(total.where(self.reaches(F.col("overlap"))).select("a", "b", "overlap"), "jaccard-links")

    def run(self) -> DataFrame:
        """Per document: id, n (set size) and component."""
        few, hot = self.members()
        close = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & self.fits())
        # Some nodes by hashes of their ids: the same ones in all keys of a group of near copies.
        pivots = hot.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(PIVOTS)])).alias("_pivots")).select("key", F.explode("_pivots").alias("id"))
        stars = hot.alias("x").join(hot.join(pivots, ["key", "id"]).alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & self.fits("w", PARITY) & self.first_met())
        pairs = materialize(_pairs(close).union(_pairs(stars)).distinct(), "jaccard-pairs")
        links = self.verify(pairs)
        found = components(links)
        if not hot.isEmpty():
            rest = materialize(self.across(hot, found).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-rest")
            links = links.union(self.verify(rest))
            found = components(links)
        self.links = links
        # Written, so that both sides of the join come from an exchange and a hot set of copies can be split.
        named = materialize(self.nodes.join(found, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component")), "jaccard-classes")
        return self.rows.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))

    def across(self, hot: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of hot keys whose nodes lie in different components, met block by block."""
        known = hot.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        apart = known.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("key")
        known = known.join(apart, "key")
        blocks = F.ceil(F.col("many") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("id"), blocks).cast("int")
        known = known.withColumn("_block", own).withColumn("_blocks", blocks)
        every = F.sequence(F.lit(0), F.col("_blocks") - 1)
        meets = known.withColumn("_meet", F.explode(F.transform(every, lambda o: F.least(o, F.col("_block")) * F.col("_blocks") + F.greatest(o, F.col("_block")))))
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x._meet") == F.col("y._meet")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
        return _pairs(meets.alias("x").join(meets.alias("y"), on & self.fits("w", PARITY) & self.first_met())).distinct()


def bloom_words(places: DataFrame, size: int) -> np.ndarray:
    """The words of a filter of 2^size bits in which all bits named by the columns are set."""
    bits = places.select(F.explode(F.array(*places.columns)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (size - 6), dtype=np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return words


def _places() -> list:
    """The bits of column node in a filter of 2^BLOOM bits."""
    return [F.shiftrightunsigned(F.xxhash64("node"), 20 * i).bitwiseAND(F.lit((1 << BLOOM) - 1)).alias(f"at{i}") for i in range(3)]


def _hit(words: np.ndarray | None, columns: list, rows: int) -> np.ndarray:
    """Which rows have all their bits in the filter."""
    kept = np.ones(rows, dtype=bool)
    for column in columns:
        bit = column.to_numpy()
        kept &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
    return kept


def _pairs(met: DataFrame) -> DataFrame:
    """a < b of rows x and y, with the sizes and first signatures of their sets."""
    low = F.col("x.id") < F.col("y.id")
    either = lambda c, name: (F.when(low, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(f"{name}a" if name else "a"), F.when(low, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(f"{name}b" if name else "b"))
    return met.select(*either("id", ""), *either("n", "n"), *either("s1", "s"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    out = Join(table(spark, sf_dir, "documents"), 3, 90, 100).run()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
