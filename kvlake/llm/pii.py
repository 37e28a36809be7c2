"""Personal data in texts by weak supervision.

Candidates come from strict patterns (the base kinds email, ip, card and phone, which are always kept) and wider ones:
disguised addresses, numbers without a plus or with a failing check digit, account and social security numbers, names,
and secrets (keys, tokens and passwords: unbroken strings of letters and digits).
Every candidate gets a vote (for, against, none) from six labelers: its pattern, a check (Luhn, ranges, mod 97, mixture
of characters), a gazetteer (domains, country codes, issuers, given names, key prefixes), words before it that speak for
or against its kind, and its edges.  Expectation-maximisation over the counted vote patterns of the whole corpus
estimates how reliable each labeler is and how likely each pattern is personal; a logistic span classifier on votes, kind
and length is trained with those probabilities and decides about the candidates beyond the base ones.  Only the counts
of patterns (at most KINDS x 3^6 x 4) reach the driver.

Null texts count as empty.  Offsets are code points, ends exclusive.  Every scan takes time in proportion to the text,
whatever it holds, and whole texts are read, however long.  Of candidates that overlap, the leftmost, then the longest,
then the first in the order of NARROW_FIRST counts.  Repeated rows are searched each; an empty table gives an empty result and a
classifier that adds nothing.  ``find`` reads the id and the text only; ``mask`` returns all columns, whatever their
names, and changes the text alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "name", "secret", "ssn")
#: Which kind a candidate is if patterns of several kinds match the same characters.
NARROW_FIRST = ("email", "ssn", "iban", "card", "ip", "phone", "secret", "name")
LABELERS = 6
#: The labelers of words before a candidate.
WORDS = (3, 4)
#: The least that a word before a candidate counts, in log odds.
LEAST_WORD = float(np.log(4))
#: An added span needs this probability.
ADD_FROM = 0.8
#: Characters before a candidate in which words count.
NEAR = 40

# Scans start at the first character of a run only and never step back, so no text takes quadratic time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_AT = re.compile(r"[(\[{][aA][tT][)\]}]")
_DOT = re.compile(r" [dD][oO][tT] [A-Za-z0-9]")
_DISGUISED = r"\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[A-Za-z0-9-]{1,63})+| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+"
_WIDE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:{_DISGUISED})", re.I),
    "phone": re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![\w-])"),
    "card": re.compile(r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{16,128}={0,2}(?![\w+/=-])"),
    "name": re.compile(r"[A-Z][^\W\d_]{1,20}\.? [A-Z][^\W\d_]{1,30}(?:-[A-Z][^\W\d_]{1,30})?(?: [A-Z][^\W\d_]{1,30})?(?!\w)"),
}

# A capital begins the pattern, so a search goes from capital to capital.
_CAPITAL = re.compile(r"[A-Z][^\W\d_]{1,20}(?=\.? [A-Z])")

# Gazetteers and cue words (fixed values).
DOMAINS = set("com org net edu gov info biz io de fr es it uk us eu ch at nl be pt pl se no dk fi ca au br jp cn in ru".split())
COUNTRY_CODES = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 60 61 62 63 64 65 66 7 81 82 86 90 91".split())
GIVEN = set(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah "
    "Anna Peter Maria Hans Klaus Ursula Wolfgang Monika Jürgen Petra Dieter Sabine Stefan Andrea Jean Pierre Marie Claude Michel Nathalie Philippe Isabelle Alain Sylvie Nicolas Catherine François Françoise Jose José Carmen Carlos Juan Ana Luis Laura Antonio Francisco Manuel Isabel Javier Lucia Lucía Miguel Elena Pablo Emma Olivia Lucas Sophie Noah Mia Liam Leon Hannah Louis Chloé Ivan Olga Dmitri Natalia Mohammed Fatima Ahmed Aisha Wei Li Yuki Hiroshi Priya Raj".split()
)
#: Beginnings of keys and tokens of well-known services.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "SG_", "npm_")
TITLES = set("Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Don".split())
CUES = {
    "email": ("mail", "contact", "write to", "reach", "correo"),
    "ip": ("ip", "address", "host", "server", "login from"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel", "llam"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "name": ("name", "mr", "mrs", "dear", "signed", "herr", "frau", "by"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "bearer", "credential", "kennwort", "passwort", "contraseña", "clave", "mot de passe"),
    "ssn": ("ssn", "social security", "tax id"),
}
#: Words before an unbroken string that speak of a digest or a name of a thing.
DIGESTS = ("sha", "md5", "checksum", "digest", "commit", "hash", "uuid", "integrity", "etag", "revision")
AGAINST = ("version", "isbn", "issn", "order", "invoice", "page", "chapter", "no.", "nr.", "$", "€", "#", "id=", "build", "release", "v.")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def byte_sized(part: str) -> bool:
    """Whether a decimal number of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def email_spans(text: str) -> list[tuple[int, int]]:
    """Addresses, found from each at sign: the run before it, as far as no address has taken it, and the domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        after = _DOMAIN.match(text, at + 1)
        before = _LOCAL.match(text[free:at][::-1]) if after else None
        free = at + 1
        if before:
            found.append((at - before.end(), after.end()))
            free = after.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict kinds, leftmost and not overlapping within a kind; matches that fail their check are dropped."""
    found = [("email", a, b) for a, b in email_spans(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(byte_sized, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def mixed(span: str) -> bool:
    """Whether a string has letters, at least four digits and many different characters, as keys and tokens have."""
    digits = len(span) - len(re.sub("[0-9]", "", span))
    return 4 <= digits < len(span) and len(set(span)) >= 8


def wide_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap neither base spans nor each other, leftmost first."""
    found = []
    if _AT.search(text) or _DOT.search(text):
        found += [("email", *m.span()) for m in _WIDE["email"].finditer(text)]
    if _DIGIT.search(text):
        for kind in ("phone", "ssn", "iban", "card"):
            found += [(kind, *m.span()) for m in _WIDE[kind].finditer(text)]
        found += [("secret", *m.span()) for m in _WIDE["secret"].finditer(text) if mixed(m[0])]
    for m in _CAPITAL.finditer(text):
        at = m.start()
        if (m[0] in TITLES or m[0] in GIVEN) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            whole = _WIDE["name"].match(text, at)
            if whole and (m[0] in TITLES or "." not in whole[0]):
                found.append(("name", *whole.span()))
    # Base spans merged to disjoint ones, so that one step of a search finds what overlaps.
    begins, ends = [], []
    for _, a, b in taken:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    kept, end = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], NARROW_FIRST.index(s[0]))):
        before = bisect_left(begins, b) - 1
        if a >= end and (before < 0 or ends[before] <= a):
            kept.append((kind, a, b))
            end = b
    return kept


def _vote(sure: bool | None) -> int:
    return 0 if sure is None else 1 if sure else 2


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """0 no vote, 1 for, 2 against, from each labeler; then the class of length."""
    span = text[a:b]
    digits = _NOT_DIGITS.sub("", span)
    before = text[max(0, a - NEAR) : a].lower()
    check: bool | None = None
    known: bool | None = None
    if kind == "email":
        tail = re.split(r"[.\]\)\}\s]+", span[-80:])[-1].lower()
        check, known = (not tail.isdigit() or None), tail in DOMAINS or None
    elif kind == "ip":
        check = all(map(byte_sized, span.split(".")))
    elif kind == "card":
        check, known = luhn(digits), digits[0] in "3456"
    elif kind == "phone":
        check = 9 <= len(digits) <= 15
        known = span[0] == "+" and digits.startswith(COUNTRY_CODES) or None
    elif kind == "iban":
        flat = span.replace(" ", "")
        check = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    elif kind == "ssn":
        check = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00"
    elif kind == "name":
        words = span.replace(".", "").split()
        known = any(w in GIVEN for w in words[:2]) and words[-1] not in GIVEN or None
    elif kind == "secret":
        check, known = sum(c.isdigit() for c in span) * 8 >= len(span) and len(set(span)) >= 10, span.startswith(KEY_PREFIXES) or None
    cue = any(re.search(rf"(?<!\w){re.escape(c)}", before) for c in CUES[kind]) or None
    against = False if any(c in before[-16:] for c in (DIGESTS if kind == "secret" else AGAINST)) else None
    open_to = "_/" if kind == "secret" else "=_/"
    edges = not (a and (text[a - 1].isalnum() or text[a - 1] in open_to) or b < len(text) and (text[b].isalnum() or text[b] in "=_/"))
    return (*map(_vote, (strict or None, check, known, cue, against, edges)), min((b - a) // 8, 3))


@dataclass
class SpanModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def inputs(kind: str, marks: tuple[int, ...]) -> np.ndarray:
        x = np.zeros(2 * LABELERS + 4 + len(KINDS) + 1)
        for i, v in enumerate(marks[:LABELERS]):
            if v:
                x[2 * i + v - 1] = 1
        x[2 * LABELERS + marks[-1]] = 1
        x[2 * LABELERS + 4 + KINDS.index(kind)] = 1
        x[-1] = 1
        return x

    def probability(self, kind: str, marks: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-self.inputs(kind, marks) @ self.weights))) if len(self.weights) else 0.0

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and all spans, by start, then kind."""
        base = base_spans(text)
        added = [s for s in wide_spans(text, base) if self.probability(s[0], votes(text, *s, False)) >= ADD_FROM]
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def expect(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> np.ndarray:
    """Probability of being personal for each counted vote pattern, by EM over two classes.

    Of the labelers WORDS, which look at the words before a candidate, silence counts as a vote of its own: whether such a
    word is there tells something.  The others are silent where they can't tell, which says nothing.  No labeler is
    taken to be worse than chance, and a word before a candidate counts LEAST_WORD at least.
    """
    marks = np.array([p[1][:LABELERS] for p in patterns])
    n = np.array([p[2] for p in patterns], dtype=float)
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    for_, against = (marks == 1).sum(axis=1), (marks == 2).sum(axis=1)
    # The first estimate is the majority of votes.
    p = (for_ + 0.5) / (for_ + against + 1)
    for _ in range(rounds):
        both = n * (1 - p), n * p
        share = np.array([np.bincount(kinds, w, len(KINDS)) + 1 for w in both])
        odds = np.log(share[1] / share[0])[kinds]
        for i in range(LABELERS):
            seen = np.array([np.bincount(marks[:, i], w, 3) + 1 for w in both])
            if i not in WORDS:
                seen[:, 0] = 0
            rate = seen / seen.sum(axis=1, keepdims=True)
            gain = np.log(np.where(rate[1] > 0, rate[1], 1.0)) - np.log(np.where(rate[0] > 0, rate[0], 1.0))
            # No vote speaks for the other side; one of a word that stands there speaks for its own.
            least = LEAST_WORD if i in WORDS else 0.0
            gain[1], gain[2] = max(gain[1], least), min(gain[2], -least)
            odds += gain[marks[:, i]]
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return p


def train(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60, ridge: float = 1.0) -> SpanModel:
    """The span classifier: ridge logistic regression on EM's probabilities, by bounded Newton steps."""
    if not patterns:
        return SpanModel()
    target = expect(patterns)
    x = np.stack([SpanModel.inputs(k, m) for k, m, _ in patterns])
    n = np.array([c for _, _, c in patterns], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (target - p)) - ridge * w)
        w += np.clip(step, -1, 1)
    return SpanModel(w)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count the vote patterns of all candidates of all documents and train on them."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                counts.update((s[0], votes(text, *s, True)) for s in base)
                counts.update((s[0], votes(text, *s, False)) for s in wide_spans(text, base))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array(["".join(map(str, m)) for _, m in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["kind", "marks", "n"])

    found = arrow_map(docs.select(text_col), run, "kind string, marks string, n long").groupBy("kind", "marks").agg(F.sum("n").alias("n")).orderBy("kind", "marks").collect()
    return train([(r["kind"], tuple(map(int, r["marks"])), r["n"]) for r in found])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans: arrays of (kind, start, stop)."""
    span = "array<struct<kind:string,start:int,stop:int>>"
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, base {span}, spans {span}"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            both = [model.spans(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in b[i]] for b in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "base", "spans"])

    return arrow_map(docs.select(id_col, text_col), run, schema)


def mask(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with the spans of its texts masked; null texts stay null, all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if t.as_py() is None else masked(t.as_py(), model.spans(t.as_py())[1]) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return arrow_map(docs, run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[many(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
