"""Document fingerprints by winnowing over character k-grams, in DataFrame and SQL functions only.

Every run of ``k`` code points has a 64-bit hash.  Of every ``window`` adjacent grams the lowest hash is kept, the
rightmost on ties, with its position.  So any passage of ``k + window - 1`` equal code points (GUARANTEE), wherever it
stands and in whatever script, leaves the same hash in both fingerprints.  A text with fewer than ``k`` code points is one
gram; one with fewer than ``window`` grams is one window; an empty or null text has an empty fingerprint, which is like
another empty one (1.0) and unlike any other (0.0).  Nothing is normalised.

A text becomes four bytes a code point, so a gram is a slice of bytes at a known place.  Texts are cut into blocks of
BLOCK windows, a row each, and every gram of a block is a column of its own: hashes, minima of four and minima of sixteen
are plain expressions that Spark compiles, where a lambda over an array is interpreted for every gram.  So many columns
also keep these steps out of one generated method, which would be too long for the JVM to compile.  Hash and position
share one long: the upper 54 bits are the hash, the lower ten the position counted from the end of the block, so the least
value is the rightmost of equal hashes.  A block knows the window before its first, so no gram is kept by two blocks.
The blocks of a row meet again where the row was; nothing is moved for that.

An edited text is made of the beginnings of two texts whose fingerprints are known, so only windows around the seam and
at the end are looked at again.

The next document in the order of ids comes from a window inside id ranges; their number follows that of the rows, and the
first row of each range also goes to the range before it, so nothing is ever sorted in one task.  Rows that repeat an id
follow each other by text; a null id comes first.  An empty table gives an empty result.  Only id and text are read,
whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points a gram and grams a window; the window is 16 or another square of a power of two.
K, WINDOW = 8, 16
GUARANTEE = K + WINDOW - 1
#: Windows of a block, and the bits of a position in it.
BLOCK, BITS = 112, 10
LOW = (1 << BITS) - 1
#: Code points to either side of a seam that windows around a gram near it reach, and those that make a part long.
REACH, LONG = K + 2 * WINDOW - 3, 4 * (K + WINDOW)
#: Stands above all values of grams.
NONE = 2**63 - 1
#: Rows of an id range; ranges that are cut by quantiles, and in all.
RANGE, QUANTILES, RANGES = 512, 4096, 1 << 20

def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def blocks(text: Column, which: int, k: int = K, window: int = WINDOW) -> Column:
    """array<struct>: the blocks of a text, one at least.

    which: as given; s: the first window; n: grams of the block, counted from the one before s; w: its windows; c: the
    code points from the one before s on, four bytes each.
    """

    def cut(units: Column) -> Column:
        chars = (F.octet_length(units) / 4).cast("int") - 1
        # A slice beyond the end is cut, so a text shorter than a gram is one gram.
        grams = F.when(chars == 0, 0).otherwise(F.greatest(chars - (k - 1), F.lit(1)))
        windows = F.least(grams, F.greatest(grams - (window - 1), F.lit(1)))
        block = lambda s: F.struct(
            F.lit(which).alias("which"), s.alias("s"), F.least(grams - s + 1, F.lit(BLOCK + window)).alias("n"), F.least(windows - s, F.lit(BLOCK)).alias("w"),
            F.substring(units, s * 4 + 1, F.lit(4 * (BLOCK + window + k - 1))).alias("c"),
        )
        return F.transform(F.sequence(F.lit(0), F.greatest(windows - 1, F.lit(0)), F.lit(BLOCK)), block)

    # One code point stands before the text, as there is one before every other block.
    return _let(F.concat(F.lit(bytes(4)), F.encode(F.coalesce(text, F.lit("")), "UTF-32")), cut)


def winnow(rows: DataFrame, keys: list[str], texts: list[str], k: int = K, window: int = WINDOW) -> DataFrame:
    """``rows`` with what winnowing keeps of each of ``texts`` in its place: struct<p: array<int>, h: array<bigint>>, by position.

    Rows differ in ``keys``.  If ``rows`` are partitioned by some of these, nothing is moved.
    """
    step = int(window**0.5)
    assert step * step == window, "the window is a square"
    rest = [c for c in rows.columns if c not in (*keys, *texts)]
    cut = rows.select(*keys, F.struct(F.lit(0).alias("_"), *rest).alias("_rest"), F.explode(F.concat(*[blocks(F.col(t), i, k, window) for i, t in enumerate(texts)])).alias("_b"))
    # Not inside a condition, so that the slice of code points is read once for all grams.
    value = "greatest(shiftleft(xxhash64(substring(_b.c, {at}, {size})), {bits}) | {low}L, if({i} < _b.n, {least}L, {none}L))"
    names = [*keys, "_which", "_s", "_w", "_rest"]
    grams = cut.selectExpr(
        *keys, "_b.which AS _which", "_b.s AS _s", "_b.w AS _w", "if(_b.s = 0 AND _b.which = 0, _rest, null) AS _rest",
        *[f"{value.format(at=4 * i + 1, size=4 * k, bits=BITS, low=LOW - i, i=i, least='-' + str(2**63 - 1), none=NONE)} AS _v{i}" for i in range(BLOCK + window)],
    )
    # Minima of the first grams, then of these: window i begins at the gram before s + i.
    few = grams.selectExpr(*names, *[f"least({', '.join(f'_v{i + j}' for j in range(step))}) AS _a{i}" for i in range(BLOCK + 1 + window - step)])
    least = few.selectExpr(*names, *[f"least({', '.join(f'_a{i + step * j}' for j in range(step))}) AS _m{i}" for i in range(BLOCK + 1)])
    new = lambda i: f"{i} <= _w AND ({'_s = 0 OR ' if i == 1 else ''}_m{i} <> _m{i - 1})"
    kept = least.selectExpr(*names, f"array_remove(array({', '.join(f'if({new(i)}, _m{i}, {NONE}L)' for i in range(1, BLOCK + 1))}), {NONE}L) AS _k")
    found = kept.selectExpr(*names, f"transform(_k, v -> _s + {LOW - 1} - cast(v & {LOW}L AS int)) AS p", f"transform(_k, v -> shiftrightunsigned(v, {BITS})) AS h")
    lists = [F.collect_list(F.when(F.col("_which") == i, F.struct("_s", "p", "h"))).alias(f"_l{i}") for i in range(len(texts))]
    whole = found.groupBy(*keys).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *lists)
    ordered = whole.select(*keys, "_rest", *[F.sort_array(f"_l{i}").alias(f"_l{i}") for i in range(len(texts))])
    prints = [F.struct(F.flatten(f"_l{i}.p").alias("p"), F.flatten(f"_l{i}.h").alias("h")).alias(t) for i, t in enumerate(texts)]
    return ordered.select(*keys, *[F.col(f"_rest.{c}").alias(c) for c in rest], *prints)


def part(prints: Column, before: Column, within: Column, by: Column) -> tuple[Column, Column]:
    """``within`` positions after the first ``before`` ones, moved ``by``, and the hashes there."""
    return F.transform(F.slice(prints["p"], before + 1, within), lambda p: (p + by).cast("int")), F.slice(prints["h"], before + 1, within)


def seams(rows: DataFrame, whole: str) -> DataFrame:
    """rows with what must be winnowed anew of a text made of the first ``_kept`` code points of one and ``_taken`` of another.

    Whether a gram is kept depends on the windows around it alone, so where these lie inside either part, its prints hold.
    ``_mid`` has the code points around the seam, from ``_mid_at`` on, and ``_end`` the last ones.  Of a short second part
    ``_mid`` has all and ``_end`` nothing, of a short first part ``_mid`` is the whole.
    """
    kept, taken = F.col("_kept"), F.col("_taken")
    at = F.when(kept >= LONG, kept - REACH).otherwise(0)
    chars = F.when((kept >= LONG) & (taken >= LONG), F.lit(2 * REACH)).otherwise(kept + taken - F.col("_mid_at"))
    end = F.when((kept >= LONG) & (taken >= LONG), F.substring(whole, kept + taken - (REACH - 1), F.lit(REACH))).otherwise("")
    return rows.withColumn("_mid_at", at).withColumns({"_mid": F.substring(whole, F.col("_mid_at") + 1, chars), "_end": end})


def joined(rows: DataFrame, own: str, other: str, out: str) -> DataFrame:
    """rows with ``out``, the prints of such a text, from those of both texts and of ``_mid`` and ``_end``."""
    kept, taken, at = F.col("_kept"), F.col("_taken"), F.col("_mid_at")
    first, both = kept >= LONG, (kept >= LONG) & (taken >= LONG)
    inside = K + WINDOW - 1  # code points of a window
    upto = lambda prints, last: F.size(F.filter(F.col(f"{prints}.p"), lambda p: p <= last))
    # The numbers are columns, so that each is counted once: what of every part lies before and up to its last place.
    bounds = rows.withColumns({"_own_last": kept - inside, "_other_last": taken - inside, "_mid_first": F.when(first, F.lit(REACH - inside)).otherwise(-1), "_mid_last": F.when(both, F.lit(REACH + WINDOW - 2)).otherwise(2**31 - 1)})
    counts = bounds.withColumns({
        "_own_to": F.when(first, upto(own, F.col("_own_last"))).otherwise(0),
        "_mid_from": upto("_mid", F.col("_mid_first")), "_mid_to": upto("_mid", F.col("_mid_last")),
        "_other_from": F.size(F.filter(F.slice(F.col(f"{other}.p"), 1, WINDOW - 1), lambda p: p < WINDOW - 1)), "_other_to": F.when(both, upto(other, F.col("_other_last"))).otherwise(0),
        "_end_from": upto("_end", F.lit(REACH - inside)),
    })
    parts = [
        tuple(F.slice(F.col(f"{own}.{c}"), F.lit(1), F.col("_own_to")) for c in "ph"),
        part(F.col("_mid"), F.col("_mid_from"), F.col("_mid_to") - F.col("_mid_from"), at),
        part(F.col(other), F.col("_other_from"), F.greatest(F.col("_other_to") - F.col("_other_from"), F.lit(0)), kept),
        part(F.col("_end"), F.col("_end_from"), F.size(F.col("_end.p")) - F.col("_end_from"), kept + taken - REACH),
    ]
    return counts.withColumn(out, F.struct(F.concat(*[p for p, _ in parts]).alias("p"), F.concat(*[h for _, h in parts]).alias("h")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes without repeats."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(a: Column) -> Column:
    """All positions, a bar, and the hashes at these, in decimal."""
    return F.concat(F.array_join(a["p"].cast("array<string>"), ","), F.lit("|"), F.array_join(a["h"].cast("array<string>"), ","))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs by ranges, with ``_row``, their number in the range, and ``_after``, the text that follows."""
    order = Window.partitionBy("_range").orderBy("_edge", "_key", text_col)
    # The exchange comes first, so that only ids and texts are moved.
    ranged = in_ranges(docs, id_col).repartition(F.col("_range"))
    return ranged.withColumns({"_row": F.row_number().over(order), "_after": F.lead(text_col).over(order)}).drop("_key")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``prints``: what winnowing keeps of every text; positions count code points."""
    rows = numbered(docs.select(id_col, text_col), id_col, text_col).where(~F.col("_edge")).select("_range", "_row", id_col, F.col(text_col).alias("_text"))
    return winnow(rows, ["_range", "_row"], ["_text"]).select(id_col, F.col("_text").alias("prints"))


def in_ranges(docs: DataFrame, id_col: str, rows: int = RANGE, quantiles: int = QUANTILES, most: int = RANGES) -> DataFrame:
    """docs with ``_range``, ``_edge`` and ``_key``, so that the row after any other is in its range.

    Ids are cut into ranges of about ``rows`` rows: by at most ``quantiles`` quantiles, which reach the driver, and beyond
    that in even parts of the ids between two quantiles.  The first row of a range is also sent, as ``_edge``, to the
    range before it, that of the very first to the last.  The table of ranges has ``most`` rows at most and is broadcast;
    with so many, a range of 100 TB holds some 100 MB.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
    parts = max(1, min(most, keyed.count() // rows))
    cut = min(parts, quantiles)
    cuts = sorted(set(keyed.agg(F.percentile_approx("_key", [i / cut for i in range(1, cut)], 10 * quantiles)).first()[0])) if cut > 1 else []
    # Two steps of at most 64 comparisons each find the quantile.
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("_key")))
    longs = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    if cuts:
        steps = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
        keyed = keyed.withColumn("_step", below(longs([s[0] for s in steps])))
        keyed = keyed.withColumn("_range", F.when(F.col("_step") == 0, F.lit(0)).otherwise((F.col("_step") - 1) * 64 + below(F.array(*[longs(s) for s in steps])[F.col("_step") - 1]))).drop("_step")
    else:
        keyed = keyed.withColumn("_range", F.lit(0))
    if (even := -(-parts // cut)) > 1:
        bounds = [cuts[0], *cuts, cuts[-1]]
        low, high = F.get(longs(bounds), F.col("_range")).cast("double"), F.get(longs(bounds), F.col("_range") + 1).cast("double")
        share = F.coalesce(F.try_divide(F.col("_key") - low, high - low), F.lit(0.0))
        keyed = keyed.withColumn("_range", F.col("_range") * even + F.least(F.greatest(F.floor(share * even), F.lit(0)), F.lit(even - 1)).cast("int"))
    ranges = keyed.groupBy("_range").agg(F.min("_key").alias("_first"))
    # One row a range; the last one comes before the first.
    last = ranges.agg(F.max("_range")).first()[0]
    before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.lit(last))
    known = F.broadcast(ranges.select(F.col("_range").alias("_r"), "_first", before.alias("_back")))
    home, edge = (F.struct(F.col(r).alias("r"), F.lit(e).alias("edge")) for r, e in (("_range", False), ("_back", True)))
    met = keyed.join(known, F.col("_range") == F.col("_r"))
    spread = met.withColumn("_at", F.explode(F.when(F.col("_key") == F.col("_first"), F.array(home, edge)).otherwise(F.array(home))))
    return spread.withColumns({"_range": F.col("_at.r"), "_edge": F.col("_at.edge")}).drop("_at", "_r", "_first", "_back")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = numbered(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    cut = sized.withColumns({"_kept": F.col("n_chars").cast("int") - half, "_taken": F.least(half, F.length("_after"))})
    whole = F.concat(F.substring("text", F.lit(1), F.col("_kept")), F.substring("_after", F.lit(1), F.col("_taken")))
    # Of the row at an edge only the own fingerprint is asked for.
    edited = seams(cut.withColumn("_edited", F.when(F.col("_edge"), F.lit("")).otherwise(whole)), "_edited")
    hashed = edited.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    prints = winnow(hashed.select("_range", "_row", "_edge", "doc_id", "n_chars", "edited_sha256", "_kept", "_taken", "_mid_at", "text", "_mid", "_end"), ["_range", "_row"], ["text", "_mid", "_end"])
    follow = Window.partitionBy("_range").orderBy("_row")
    known = prints.withColumn("_own", F.array_distinct("text.h")).withColumns({"_next": F.lead("text").over(follow), "_others": F.lead("_own").over(follow)}).where(~F.col("_edge"))
    after = joined(known, "text", "_next", "_edited").withColumn("_new", F.array_distinct("_edited.h"))
    return after.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("text")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_others")).alias("near_next"),
    )
