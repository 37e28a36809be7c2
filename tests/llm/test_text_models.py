import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kvlake.llm import html_text, language, pii, quality
from kvlake.llm.html_text import main_text, op5_html_text
from kvlake.llm.language import best_path, op4_language
from kvlake.llm.pii import base_spans, masked, op6_pii
from kvlake.llm.quality import isotonic, op3_quality, statistics

P1 = "The first paragraph has enough words to look like an article, with commas, and more."
P2 = "A second paragraph follows it and is about as long as the one before it was."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>x", "x"), ("<<<>", "<<<>"), ("a < b &amp;&lt; c&nbsp; d", "a < b &< c d"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{P1}<p><b>{P2}</article><footer>f</footer>", f"T\n{P1}\n{P2}"),
        (f"<body><header>Site</header><div id=content><h1>T</h1><p>{P1}</p><p>Short.</p><p>{P2} <a href=q>link</a> end</p></div><aside>{P1}</aside><div class='comments'><p>{P1}</p></div>", f"T\n{P1}\nShort.\n{P2} link end"),
        (f"<body><div class='cookie-notice'>{P1}</div><main><article><header><h1>T &amp; U</h1></header><section><p>{P1}</p></section><section><h2>S</h2><p>{P2}</p><ul><li>one<li>two</ul></section></article><section id=comments>{P1}</section></main>", f"T & U\n{P1}\nS\n{P2}\none\ntwo"),
        (f"<article><p>{P1}<script>if(a<b){{'</p>'}}</script><style>p{{}}</style><!-- <p>no</p> --><form><p>{P2}</p></form></p></article>", P1),
        (f"<article><p>{P1}<br>more</p><div hidden>{P2}</div></article>", f"{P1} more"),
        (f"<div><ul><li><a href=1>menu one</a><li><a href=2>menu two</a></ul><div><p>{P1}</p><p>{P2}</p></div></div>", f"{P1}\n{P2}"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ('<a href="x>y', "y"),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div class='layout has-sidebar'><div class=sidebar><a href=1>x</a></div><div id=c><h1>T</h1><p>{P1}</p><p>{P2}</p></div></div>", f"T\n{P1}\n{P2}"),
        (f"<body><p>Welcome</p><div id='search-page'><p>{P1}</p><p>{P2}</p></div>", f"{P1}\n{P2}"),
        (f"<body><div class=modal><h1>T</h1><p>{P1}</p><p>{P2}</p></div>", f"T\n{P1}\n{P2}"),
        (f"<article><p>{P1}</p><section id='related-work'><h2 id='social-security'>Social</h2><p class='share-price'>{P2}</p></section></article>", f"{P1}\nSocial\n{P2}"),
        (f"<article><p>{P1}</p><h2>Sources</h2><ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul><div class=share><a href=1>Tweet</a></div><div class=ad>Buy</div></article>", f"{P1}\nSources\nSource one\nSource two"),
    ],
)
def test_marks_around_and_inside_the_article(html, want):
    assert main_text(html) == want


NAV = "<nav><a href=1>Home</a> <a href=2>More here</a></nav>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body>{NAV}<article><p>{P1}</p><p>{P2}</p></article><article><p>{P1} {P2}</p></article>", f"{P1}\n{P2}\n{P1} {P2}"),
        (f"<body>{NAV}<article><p>{P1}</p><p>{P2}</p></article><div><p>{P2} {P1}</p></div><div>Imprint</div>", f"{P1}\n{P2}\n{P2} {P1}"),
        (f"<body>{NAV}<div><p>{P1}</p><p>{P2}</p></div><div><p>{P2} {P1}</p></div><div>Imprint</div>", f"{P1}\n{P2}\n{P2} {P1}"),
    ],
)
def test_text_beside_an_article(html, want):
    assert main_text(html) == want


def page_of(draw, depth=0):
    """A random element as (tag, children), where a child is a text or an element."""
    word = lambda: "".join(draw.choice("abcdefgh,") for _ in range(draw.randrange(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    if depth > 4 or depth and draw.random() < 0.45:
        inline = [(draw.choice(["a", "b", "em"]), [words(draw.randrange(1, 6))]) for _ in range(draw.randrange(3))]
        return draw.choice(["p", "h2", "pre"]), [words(draw.randrange(1, 40)), *inline, *([words(draw.randrange(5))] if inline else [])]
    return "body" if not depth else draw.choice(["div", "section", "blockquote"]), [page_of(draw, depth + 1) for _ in range(draw.randrange(1, 5))]


def brute_density(page):
    """Densities, seed and threshold by the definitions, over the whole tree for every node."""
    import math

    nodes = []

    def visit(element, up):
        nodes.append((element, up))
        me = len(nodes) - 1
        for child in element[1]:
            if isinstance(child, tuple):
                visit(child, me)

    visit(page, -1)
    below = lambda element: [element, *(x for c in element[1] if isinstance(c, tuple) for x in below(c))]
    length = lambda element: sum(len(c.replace(" ", "")) for e in below(element) for c in e[1] if isinstance(c, str))
    links = lambda element: [e for e in below(element) if e[0] == "a"]
    share = sum(map(length, links(page))) / length(page)
    density = []
    for element, _ in nodes:
        c, t = length(element), len(below(element))
        lc, lt = max(sum(map(length, links(element))), 1), max(len(links(element)), 1)
        density.append(c / t * max(math.log(c / lc * t / lt), 0) / math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)) if c else 0)
    sums = [sum(density[j] for j, (e, up) in enumerate(nodes) if up == i and e[0] not in ("a", "b", "em")) for i in range(len(nodes))]
    seed = max((i for i in range(len(nodes)) if length(nodes[i][0])), key=lambda i: (sums[i], density[i] if not sums[i] else 0, -i))
    path, at = [], seed
    while at >= 0:
        path.append(at)
        at = nodes[at][1]
    threshold = min(density[i] for i in path)
    kept = [nodes[seed][0]] + [nodes[i][0] for i in range(len(nodes)) if density[i] >= threshold and i not in path and nodes[i][0][0] not in ("a", "b", "em")]
    texts = {c for e in kept for x in below(e) for c in x[1] if isinstance(c, str) and c.strip()}
    return density, seed, threshold, texts


def test_density_equals_brute_force():
    draw = random.Random(31)
    whole = lambda e: e if isinstance(e, str) else f"<{e[0]}>{''.join(map(whole, e[1]))}</{e[0]}>"
    other = 0
    for _ in range(150):
        tree = page_of(draw)
        page = html_text.Page(whole(tree))
        density, seed, threshold, texts = brute_density(tree)
        assert page.density[1:] == pytest.approx(density)
        inside = page.content()
        assert page.threshold == pytest.approx(threshold) and page.seed == seed + 1
        found = {t for i, t in page.items if t and t.strip() and inside[i]}
        assert texts <= found
        other += found != {t for _, t in page.items if t and t.strip()}
    assert other > 20  # pages of which only a part is content


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<div>" * 30_000 + "</x>" * 30_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "t", "<i>" * 20_000 + "<h1>" * 20_000 + "t", "<div>" * 20_000 + "<header>" * 20_000 + "t", "<div><nav>n</nav>" * 20_000 + "text", "<script>" * 20_000, "<!--" * 20_000, "<a x=\"" * 20_000])
def test_pages_take_linear_time(html):
    import time

    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 4


def test_case_of_letters_that_change_length():
    assert main_text("<p>İİİİİİİİİİ text one</p><ScRipt>x</SCRIPT ><p>tail words here and more</p>") == "İİİİİİİİİİ text one\ntail words here and more"
    assert main_text(f"<article><p>{P1}</p><p class='notice period'>{P2}</p><div class='share-price'><p>{P2}</p></div></article>") == f"{P1}\n{P2}\n{P2}"


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text(f"<article><p>{'word ' * 200_000}</article>") == " ".join(["word"] * 200_000)
    assert html_text.Page("<" * 5000).text()


def test_pages_query(spark, tables):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{P1}</article>", "x"), (2, None, None, "x"), (2, "u", "", "x"), (None, "u", "é", "x")], "page_id long, url string, html string, text string")
    rows = op5_html_text(spark, tables(pages=pages)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "é", 1), (1, P1, len(P1)), (2, "", 0), (2, "", 0)]
    assert op5_html_text(spark, tables(pages=pages.limit(0))).count() == 0


def sentences(draw, stems, n):
    return " ".join("".join(draw.choice(stems) for _ in range(draw.randrange(1, 4))).capitalize() for _ in range(n)) + "."


STEMS = {"aa": ["the", "ing", "wh", "ion", "sh"], "bb": ["sch", "ung", "ei", "ver", "ß"], "cc": ["мы", "про", "ост", "да"]}


@pytest.fixture(scope="module")
def corpus(make_docs):
    draw = random.Random(21)
    texts, langs, marks = [], [], []
    for i in range(400):
        lang = draw.choice(list(STEMS))
        text = sentences(draw, STEMS[lang], draw.randrange(20, 80))
        bad = draw.random() < 0.3
        if bad:
            text = draw.choice([" ".join(w + "!!" for w in text.upper().split()), " ".join([text.split()[0]] * 60), " ".join(w + draw.choice("#%&*") * 3 for w in text.split())])
        texts.append(text)
        langs.append(lang)
        marks.append(0 if bad else 1)
    odd = [None, "", "  ", "12 34 !!", "word", "word"]
    return make_docs(texts + odd, langs=langs + [None] * len(odd)), marks, langs


def remainder(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_quality(spark, corpus, tables):
    docs, marks, _ = corpus
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(3, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    path = tables(documents=docs, labels=labels)
    rows = {r["doc_id"]: r for r in op3_quality(spark, path).collect()}
    assert len(rows) == 406
    held = [i for i in range(400) if remainder(i, 5) == 0]
    assert all(rows[i]["held_out"] == (remainder(i, 5) == 0) for i in rows)
    assert np.mean([rows[i]["predicted"] == marks[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert {r["score"] for r in op3_quality(spark, tables(documents=docs, labels=labels.limit(0))).collect()} == {0.5}
    assert op3_quality(spark, tables(documents=docs.limit(0), labels=labels)).count() == 0
    kept = {r[0] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if r["score"] >= 0.3}


def naive_statistics(text):
    """The statistics of a text as they are described, one character, word and line after the other."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    kinds = [b" \t", b"\r\n\x0b\x0c", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b"#$%&*@^~=|<>{}[]\\_+/", bytes(range(0xC0, 256))]
    kind = lambda c: 10 if 0x80 <= c < 0xC0 else next((i for i, k in enumerate(kinds) if c in k), 9)
    count = [sum(kind(c) == i for c in raw) for i in range(10)]
    chars, n = max(sum(count), 1), max(len(words), 1)
    upper = lambda w: sum(65 <= c <= 90 for c in w)
    lower = lambda w: sum(97 <= c <= 122 for c in w)
    last = [kind(w[-1]) for w in words]
    out = [np.log1p(chars), np.log1p(len(words)), *(c / chars for c in count), count[2] / max(count[2] + count[3] + count[8], 1)]
    out += [x / n for x in (sum(upper(w) >= 2 and not lower(w) for w in words), last.count(7), last.count(6), last.count(5), sum(a == b for a, b in zip(words, words[1:])), sum(map(len, words)), sum(len(w) > 20 for w in words))]
    pairs = list(zip(words, words[1:]))
    rows = raw.split(b"\n")
    out += [len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, len(set(pairs)) / len(pairs) if pairs else 0, len(set(rows)) / len(rows)]
    return out


def test_statistics_equal_plain_counts(odd_texts):
    texts = [t for t in odd_texts if len(t or "") < 10_000] + ["Aa BB!! cc cc #x$ 12,5 \n\n a\tb", "é É ß", "x\ny\nx"]
    assert statistics(texts) == pytest.approx(np.array([naive_statistics(t) for t in texts]))


def test_quality_equals_brute_force(spark, corpus, tables):
    """The whole fit again: features, ridge by least squares on all rows, isotonic means by their min-max formula."""
    docs, marks, _ = corpus
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["score"] for r in op3_quality(spark, tables(documents=docs, labels=labels)).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    x = {i: np.array(naive_statistics(t), dtype=np.float32).astype(float) for i, t in texts.items()}
    fits, later = ([i for i in range(400) if remainder(i, 5) in part] for part in ((2, 3, 4), (1,)))
    mean, scale = np.mean([x[i] for i in fits], axis=0), np.std([x[i] for i in fits], axis=0)
    scale[scale <= 1e-9] = 1
    w, b = quality.QualityModel.plane()

    def lift(i):
        z = np.clip((x[i] - mean) / scale, -8, 8)
        return np.concatenate([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), z, [1.0]])

    a, y = np.array([lift(i) for i in fits]), np.array([marks[i] for i in fits], dtype=float)
    pull = np.sqrt(quality.RIDGE * len(fits)) * np.eye(a.shape[1])[:-1]
    weights = np.linalg.lstsq(np.vstack([a, pull]), np.concatenate([y, np.zeros(len(pull))]), rcond=None)[0]
    width = (quality.HIGH - quality.LOW) / quality.BINS
    bins = {}
    for i in later:
        at = int(min(max((lift(i) @ weights - quality.LOW) / width, 0), quality.BINS - 1))
        bins.setdefault(at, []).append(marks[i])
    keys = sorted(bins)
    rate = lambda p, q: sum(sum(bins[k]) for k in keys[p : q + 1]) / sum(len(bins[k]) for k in keys[p : q + 1])
    level = [max(min(rate(p, q) for q in range(i, len(keys))) for p in range(i + 1)) for i in range(len(keys))]
    groups = {}
    for k, v in zip(keys, level):
        groups.setdefault(round(v, 12), []).append(k)
    middle = [(sum(len(bins[k]) * (quality.LOW + (k + 0.5) * width) for k in ks) / (n := sum(len(bins[k]) for k in ks)), n, sum(sum(bins[k]) for k in ks)) for _, ks in sorted(groups.items())]
    knots = [(quality.LOW, middle[0][2] / (middle[0][1] + 1)), *((at, (o + 0.5 * o / n) / (n + 0.5)) for at, n, o in middle), (quality.HIGH, (middle[-1][2] + 1) / (middle[-1][1] + 1))]
    for i in texts:
        assert found[i] == pytest.approx(float(np.clip(np.interp(lift(i) @ weights, *zip(*knots)), 0, 1)), abs=1e-5)


def test_held_out_labels_never_train(spark, corpus, tables):
    docs, marks, _ = corpus
    make = lambda flip: spark.createDataFrame([(i, 1 - m if flip and remainder(i, 5) == 0 else m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    one, two = ({r["doc_id"]: r["score"] for r in op3_quality(spark, tables(documents=docs, labels=make(flip))).collect()} for flip in (False, True))
    assert one == pytest.approx(two, abs=1e-6)


def test_statistics_and_isotonic():
    assert statistics([]).shape == (0, quality.COUNT)
    found = statistics(["a b a b", None, "", "x", "A" * 100_000 + " b"])
    assert found.shape == (5, quality.COUNT) and np.isfinite(found).all()
    draw = np.random.default_rng(0)
    x = np.sort(draw.random(50))
    knots, means = isotonic(x, np.full(50, 4.0), draw.integers(0, 5, 50).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(means) >= -1e-12).all()


def test_language(spark, corpus, tables):
    docs, _, langs = corpus
    rows = {r["doc_id"]: r for r in op4_language(spark, tables(documents=docs)).collect()}
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in range(400)]) >= 0.97
    assert [rows[i]["lang_pred"] for i in range(400, 404)] == ["und"] * 4 and all(rows[i]["score"] == 0 for i in range(400, 404))
    assert rows[404]["lang_pred"] in STEMS and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (remainder(i, 4) == 2) for i, r in rows.items())
    assert op4_language(spark, tables(documents=docs.limit(0))).count() == 0
    model = language.learn(docs, language.trains())
    draw = random.Random(1)
    one, two = sentences(draw, STEMS["aa"], 30), sentences(draw, STEMS["cc"], 20)
    ((best, share, spans),) = model.label([f"{one} {two}"])
    raw = f"{one} {two}".encode()
    assert [s[0] for s in spans] == ["aa", "cc"] and best == "cc" and 0.4 < share < 0.8
    assert raw[spans[1][1] : spans[1][2]].decode() == two.rstrip(".")


def test_viterbi_equals_brute_force():
    draw = np.random.default_rng(3)
    lengths = [0, 1, 7, 4, 7, 0, 12]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    scores = draw.normal(size=(begins[-1], 3)).astype(np.float32)
    labels = best_path(scores, begins, 1.5)
    value = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    import itertools

    for a, b in zip(begins, begins[1:]):
        if 0 < b - a <= 7:
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a))
            assert value(labels[a:b], scores[a:b]) == pytest.approx(best, abs=1e-4)


def test_language_equals_brute_force(spark, corpus, tables):
    """Counts, scores and paths of every document again, word by word."""
    from kvlake.llm.shingles import Words

    docs, _, langs = corpus
    path = tables(documents=docs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op4_language(spark, path).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    script = lambda w: sum(language.SCRIPTS[i] <= ord(w[0]) for i in range(len(language.SCRIPTS))) - 1

    def words_of(text):
        """(lower-cased bytes, script) of the runs of letters and of bytes beyond ASCII."""
        return [(w.encode(), script(w)) for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())]

    def cells(word):
        b = b" " + word + b" "
        three = [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2**32) >> 17 for i in range(len(b) - 2)]
        return three, int(Words([word]).hashes[0]) >> 49

    names = sorted(set(langs))
    grams, whole, scripts = ({n: {} for n in names} for _ in range(3))
    for i in range(400):
        if remainder(i, 4) != 2:
            for word, kind in words_of(texts[i]):
                three, one = cells(word)
                for into, keys in ((grams, three), (whole, [one]), (scripts, [kind])):
                    for k in keys:
                        into[langs[i]][k] = into[langs[i]].get(k, 0) + 1
    size = language.BUCKETS
    log = lambda t, n, k: np.log((t[n].get(k, 0) + 0.5) / (sum(t[n].values()) + 0.5 * size))
    share = lambda n, k: scripts[n].get(k, 0) >= language.SHARE * max(sum(scripts[n].values()), 1)
    for i, text in texts.items():
        words = words_of(text)
        if not words:
            assert found[i] == ("und", 0.0)
            continue
        value, back = np.zeros(len(names)), []
        for word, kind in words:
            three, one = cells(word)
            able = [share(n, kind) for n in names]
            able = able if any(able) else [True] * len(names)
            own = np.array([sum(log(grams, n, k) for k in three) + log(whole, n, one) if ok else -1e6 for n, ok in zip(names, able)])
            own = np.maximum(own - own.max(), -language.MOST)
            step = value[:, None] - language.SWITCH * (1 - np.eye(len(names)))
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + own
        path = [int(value.argmax())]
        for choice in reversed(back[1:]):
            path.append(int(choice[path[-1]]))
        letters = np.bincount(path[::-1], [len(w) for w, _ in words], len(names))
        assert found[i][0] == names[int(letters.argmax())] and found[i][1] == pytest.approx(letters.max() / letters.sum())


def test_lower_case_by_code_point():
    assert language.lowered("Ä Ö İ K").decode() == "ä ö İ k" and language.lowered("ÄB Ö") == "äb ö".encode()
    for text in ("ΟΔΟΣ İ ẞ Ⱥx", "AİB" * 50, "x"):
        assert len(language.lowered(text)) == len(text.encode())


CARD = "4539 1488 0343 6467"


def test_base_spans():
    text = f"mail a.b+c@mail.example.com, 192.168.0.1 or 300.1.1.1; {CARD} +1 (988) 555-2485 and 1234567890123456."
    found = {k: text[a:b] for k, a, b in base_spans(text)}
    assert found == {"email": "a.b+c@mail.example.com", "ip": "192.168.0.1", "card": CARD, "phone": "+1 (988) 555-2485"}
    assert base_spans("é 😀 x@y.zz") == [("email", 4, 10)]
    assert base_spans("") == [] and base_spans("+1 2 " * 20000) is not None
    assert masked(text, base_spans(text)).startswith("mail <email>, <ip> or 300.1.1.1; <card> <phone> and")


def naive_spans(text):
    """The base patterns as they are written down, by plain backtracking and whole numbers."""
    sum_of = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(int(p[:4000]) for p in m[0].split(".")) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [c for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum_of(d) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_base_spans_equal_plain_patterns(odd_texts):
    draw = random.Random(17)
    seen = set()
    for letters in ("a@.", "a@.-_ ", "12. ", "0123456789 -", "+1 ().-", "++0123456789.-", "a1@.+ -", "٣é1.@+ "):
        for _ in range(1500):
            text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
            assert base_spans(text) == naive_spans(text), text
            seen |= {k for k, _, _ in naive_spans(text)}
    for text in odd_texts:
        assert base_spans(text or "") == naive_spans(text or "")
    assert seen == {"email", "ip", "card", "phone"}


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "1" * 5000 + ".1.1.1", "1." * 300_000, "a@" * 300_000, "a@b." * 200_000, "+1 " * 300_000, "a1" * 300_000, "1 " * 300_000, "Mary " * 100_000, "DE12 " + "ABCD " * 100_000])
def test_scans_take_linear_time(text):
    import time

    began = time.process_time()
    base = base_spans(text)
    for s in pii.wide_spans(text, base)[:100]:
        pii.votes(text, *s, False)
    for s in base[:100]:
        pii.votes(text, *s, True)
    assert time.process_time() - began < 5


def test_labels_and_expectation():
    good, bad = (1, 1, 1, 1, 0, 1, 2), (0, 2, 2, 0, 2, 2, 2)
    p = pii.expect([("phone", good, 50), ("phone", bad, 200)])
    assert p[0] > 0.9 > 0.1 > p[1]
    model = pii.train([("phone", good, 50), ("phone", bad, 200)])
    assert model.probability("phone", good) > 0.8 > 0.2 > model.probability("phone", bad)
    assert pii.train([]).probability("phone", good) == 0


def planted(draw):
    """(text, personal spans beyond the base ones, decoys) of one document."""
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    card = digits(15)
    card += next(c for c in "0123456789" if not pii.luhn(card + c))
    hexes = "".join(draw.choice("0123456789abcdef") for _ in range(40))
    account = "1".join(["DE00", "2", "3"]) + digits(14)
    account = f"DE{98 - int(''.join(str(int(c, 36)) for c in account[4:] + 'DE00')) % 97:02d}{account[4:]}"
    kind, text, span = draw.choice(
        [
            ("", f"write to x{digits(3)}@mail.com or call +49 30 {digits(7)} now", None), ("", f"the host 10.0.{draw.randrange(256)}.9 is up", None),
            ("", "plain words that hold nothing", None), ("decoy", f"serial {card} of the part", card), ("decoy", f"commit {hexes} of the branch", hexes),
            ("secret", f'token = "{hexes}" in use', hexes), ("email", f"mail jane.doe{digits(2)} (at) mail (dot) com today", None), ("iban", f"my account {account} at the bank", account),
            ("name", "Dear Mary Holton, we write", "Mary Holton"), ("ssn", f"social security 123-45-{digits(4)} given", None),
        ]
    )
    if kind == "email":
        span = re.search(r"jane\S+ \(at\) mail \(dot\) com", text)[0]
    if kind == "ssn":
        span = re.search(r"123-45-\d+", text)[0]
    at = text.index(span) if span else 0
    return text, kind, (at, at + len(span)) if span else None


def test_pii_query(spark, make_docs, odd_texts, tables):
    draw = random.Random(23)
    more = [planted(draw) for _ in range(600)]
    texts = odd_texts + ["1" * 200_000, "1" * 5000 + ".1.1.1", "a" * 200_000] + [t for t, _, _ in more]
    rows = {r["doc_id"]: r for r in op6_pii(spark, tables(documents=make_docs(texts))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = naive_spans(text or "") if len(text or "") < 100_000 else []
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert set(filter(None, joined.split(","))) <= set(rows[i]["spans"].split(","))
    assert all(re.fullmatch(r"(\w+:\d+:\d+(,|$))*", r["spans"]) for r in rows.values())
    # Beyond the base spans: what is planted is found, what only looks alike is not.
    first = len(texts) - len(more)
    wanted = {(first + i, f"{kind}:{span[0]}:{span[1]}") for i, (_, kind, span) in enumerate(more) if kind not in ("", "decoy")}
    base = {(i, f"{k}:{a}:{b}") for i, t in enumerate(texts) if i >= first for k, a, b in naive_spans(t)}
    added = {(i, s) for i in rows if i >= first for s in rows[i]["spans"].split(",") if s} - base
    assert len(wanted & added) >= 0.95 * len(wanted) and len(wanted & added) >= 0.95 * len(added)
    assert op6_pii(spark, tables(documents=make_docs([]))).count() == 0


def test_rare_language_is_learned(spark):
    """With one language at nearly all rows, a small sample still draws the others whole."""
    draw = random.Random(5)
    rows = [(i, sentences(draw, STEMS["aa"], 12), "aa") for i in range(1500)] + [(i, sentences(draw, STEMS["bb"], 12), "bb") for i in range(1500, 1506)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, language.F.lit(True), sample=40)
    assert model.languages == ["aa", "bb"]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert all(found[i] == "bb" for i in range(1500, 1506)) and sum(found[i] == "aa" for i in range(1500)) > 1450


def test_documents_stay_without_labels(make_docs):
    assert language.keep_known(make_docs(["Some words here.", None, "more"])).count() == 3
