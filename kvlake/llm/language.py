"""Language of texts: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters.  Its score for a language is the sum of log-probabilities of its lower-cased byte trigrams
(with the boundaries) and of the word itself, learned from texts of known language; its script, by the range of its
first letter, excludes languages that were hardly ever seen in that script.  Viterbi with a penalty for every change of
language then labels all words of a text, so a short foreign word doesn't break a span, while a long foreign passage
becomes one.  All documents of a batch go through the recursion side by side.

The prediction is the language of most letters by these labels, the score its share of them.  Null texts and those
without a letter are ``und`` with score 0.  The sample for learning is bounded by SAMPLE documents (expected), drawn by
a hash of the id from each language in even parts; languages with fewer documents are drawn whole.  Whole texts are
labelled, however long; a very long one makes a batch of its own.  Of languages with equally many letters the first in
order counts.  Repeated rows are predicted each; an empty table gives an empty result; without training rows every text is
``und``.  Only id, text and language are read, whatever other columns are called; ``keep_known`` returns all columns.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map
from kvlake.llm.quality import fold
from kvlake.llm.shingles import Words, chunks

#: Expected documents to learn from, tables of hashed trigrams and words, cost of a change of language in nats.
SAMPLE, BUCKETS, SWITCH = 8000, 1 << 15, 8.0
#: A word speaks for or against a language by this much at most; a script counts for a language from this share on.
MOST, SHARE = 12.0, 0.01
#: Words that go through the recursion together.
TOGETHER = 250_000

# First code points of script ranges, in order.
SCRIPTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0xAC00, 0xD7B0, 0x10000, 0x20000]

_LETTER = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _kept(point: str) -> bool:
    """Whether the lower case of a code point has as many bytes."""
    return len(point.lower().encode()) == len(point.encode())


@functools.cache
def _changing() -> re.Pattern:
    """The code points that are longer or shorter in lower case, some thirty."""
    return re.compile("[" + "".join(chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and not _kept(chr(c))) + "]")


def lowered(text: str) -> bytes:
    """Lower-cased UTF-8 of the same length, everything but letters of ASCII and higher bytes blank.

    A code point whose lower case has another length stays as it is.
    """
    if not text.isascii():
        changing = _changing()
        text = "".join(part if i % 2 else part.lower() for i, part in enumerate(re.split(f"({changing.pattern})", text))) if changing.search(text) else text.lower()
    return text.encode().translate(_LETTER)


class Grams:
    """Hashed trigrams of every letter byte, hashed words and scripts of some texts."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        b = np.concatenate([[32], w.buffer, [32, 32]]).astype(np.uint32)
        at = np.flatnonzero(w.buffer != 32)
        three = (b[at] << 16) | (b[at + 1] << 8) | b[at + 2]
        self.grams = ((three * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
        self.first = np.cumsum(w.lengths) - w.lengths
        self.whole = (w.hashes >> np.uint64(49)).astype(np.int32)
        c = b[w.starts + 1], b[w.starts + 2] & 63, b[w.starts + 3] & 63
        two, more = ((c[0] & 31) << 6) | c[1], ((c[0] & 15) << 12) | (c[1] << 6) | c[2]
        point = np.where(c[0] < 0xC0, c[0], np.where(c[0] < 0xE0, two, np.where(c[0] < 0xF0, more, 0x10000)))
        self.scripts = np.searchsorted(SCRIPTS, point, "right") - 1


def best_path(scores: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words (rows of scores) of several texts, each text by its own Viterbi path."""
    lengths = np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], begins[:-1][order]
    steps = int(lengths[0]) if len(lengths) else 0
    # Texts still running at each step form a prefix of the order.
    running = np.searchsorted(-lengths, -np.arange(steps), "left")
    kinds = scores.shape[1]
    columns = np.ascontiguousarray(scores.T)
    stay = np.empty((kinds, len(scores)), dtype=bool)
    leave = np.empty(len(scores), dtype=np.int16)
    value = np.zeros((kinds, len(lengths)), dtype=np.float32)
    ended = np.zeros(len(lengths), dtype=np.int16)
    for t in range(steps):
        n = running[t]
        at = starts[:n] + t
        v = value[:, :n]
        best = v.max(axis=0)
        leave[at] = v.argmax(axis=0)
        stay[:, at] = v >= best - penalty
        value[:, :n] = np.maximum(v, best - penalty) - best + columns[:, at]
    ended = value.argmax(axis=0).astype(np.int16)
    labels = np.empty(len(scores), dtype=np.int16)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        here = ended[:n]
        labels[at] = here
        if t:
            ended[:n] = np.where(stay[here, at], here, leave[at])
    return labels


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray
    whole: np.ndarray
    allowed: np.ndarray

    def scores(self, g: Grams) -> np.ndarray:
        out = np.empty((len(g.words.starts), len(self.languages)), dtype=np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.grams[k][g.grams], g.first) + self.whole[k][g.whole] if len(g.first) else 0
        out[~self.allowed[:, g.scripts].T] = -1e6
        return np.maximum(out - out.max(axis=1, keepdims=True), -MOST)

    def label(self, texts: list[str | None]):
        """For each text: language, score and spans (language, first byte, byte after the last)."""
        held: list[tuple[np.ndarray, ...]] = []
        words, done = 0, 0
        for chunk in chunks(lowered(t or "") for t in texts):
            g = Grams(chunk)
            w = g.words
            # Only what the labels need stays: word counts, places and lengths, scores.
            offsets = w.ends_of_text - [len(t) + 1 for t in chunk]
            held.append((np.diff(w.begins), w.starts, w.lengths.astype(np.int32), offsets, self.scores(g)))
            words += len(w.starts)
            del g, w
            if words >= TOGETHER:
                yield from self._label(held, texts[done : (done := done + sum(len(h[0]) for h in held))])
                held, words = [], 0
        if held:
            yield from self._label(held, texts[done:])

    def _label(self, held, texts):
        counts, starts, lengths, offsets, scores = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        begins = np.concatenate([[0], np.cumsum(counts)])
        labels = best_path(scores, begins, SWITCH)
        del scores
        sums = np.stack([np.concatenate([[0], np.cumsum(np.where(labels == k, lengths, 0))]) for k in range(len(self.languages))])
        sums = sums[:, begins[1:]] - sums[:, begins[:-1]]
        for i, text in enumerate(texts):
            a, b = begins[i], begins[i + 1]
            if a == b or not any(map(str.isalpha, text)):
                yield "und", 0.0, []
                continue
            best = int(sums[:, i].argmax())
            own = labels[a:b]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.concatenate([cuts[1:], [b - a]]) - 1
            at = starts[a:b] - offsets[i]
            yield self.languages[best], float(sums[best, i] / sums[:, i].sum()), [(self.languages[own[c]], int(at[c]), int(at[d] + lengths[a + d])) for c, d in zip(cuts, last, strict=True)]


def learn(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Count trigrams, words and scripts of about ``sample`` documents for which ``trains`` holds and lang is known.

    Every language gets an even part of the sample, what small ones leave goes to larger ones, and a language with fewer
    documents than its part is drawn whole.
    """
    known = docs.where(trains & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    shares, left = {}, sample
    for i, (lang, total) in enumerate(sorted(totals.items(), key=lambda x: (x[1], x[0]))):
        part = max(1, min(total, left // (len(totals) - i)))
        shares[lang], left = part / total, left - part
    # Documents are drawn by the hash of their id; nothing is cut where a language is drawn whole.
    drawn = known
    if any(share < 1 for share in shares.values()):
        share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col(lang_col)]
        drawn = known.where((share >= 1) | (F.pmod(F.xxhash64(id_col, F.lit(4)), F.lit(1 << 40)) < share * (1 << 40)))
    # The draw is bounded, so a fixed number of tasks counts it.
    drawn = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).repartition(8)
    size = 2 * BUCKETS + len(SCRIPTS)

    def run(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(lowered(text))
            for lang, texts in by.items():
                into = counts.setdefault(lang, np.zeros(size, dtype=np.int64))
                for chunk in chunks(texts):
                    g = Grams(chunk)
                    into[:BUCKETS] += np.bincount(g.grams, minlength=BUCKETS)
                    into[BUCKETS : 2 * BUCKETS] += np.bincount(g.whole, minlength=BUCKETS)
                    into[2 * BUCKETS :] += np.bincount(g.scripts, minlength=len(SCRIPTS))
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["lang", "cell", "n"])

    # At most 65,567 cells a language.
    found = arrow_map(drawn, run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names, cells, n = found.column("lang").to_pylist(), found.column("cell").to_numpy(), found.column("n").to_numpy()
    languages = sorted(set(names))
    table = np.zeros((len(languages), size))
    table[[languages.index(x) for x in names], cells] = n
    log = lambda x: np.log((x + 0.5) / (x.sum(axis=1, keepdims=True) + 0.5 * x.shape[1])).astype(np.float32)
    scripts = table[:, 2 * BUCKETS :]
    allowed = scripts >= SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, log(table[:, :BUCKETS]), log(table[:, BUCKETS : 2 * BUCKETS]), allowed | ~allowed.any(axis=0))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and on request the spans (language, byte offsets of the UTF-8 text)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double" + ", spans array<struct<lang:string,start:int,stop:int>>" * spans

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = list(model.label(texts)) if model.languages else [("und", 0.0, [])] * len(texts)
            more = [pa.array([[dict(zip(("lang", "start", "stop"), s, strict=True)) for s in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))] if spans else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *more], names=[*keep, "lang_pred", "score", *["spans"] * spans])

    return arrow_map(docs.select(*keep, F.col(text_col).alias("_text")), run, schema)


def trains() -> Column:
    return F.coalesce(fold("doc_id", 4) != 2, F.lit(False))


#: The pipeline drops documents in which no language has this share of the letters.
KEEP_FROM = 0.4


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are mostly of one known language; all of them where no language is known."""
    model = learn(docs, trains())
    if not model.languages:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = model.label(texts)
            yield batch.filter(pa.array([lang != "und" and share >= KEEP_FROM for lang, share, _ in found], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs, trains()), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
