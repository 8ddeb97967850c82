"""Main text of pages, filter interaction and periodic runs, by brute force and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction
from math import factorial

import pytest
from pyspark.sql import functions as F

from gridloom.llm import interaction, mainhtml, periodic


# Periodic runs


def runs_by_force(x, least=6, times=4):
    out, n = set(), len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, times * q) and not any(p < q and a <= s and a + m >= s + length for a, m, p in out):
                out.add((s, length, q))
            i += i == s
    return out


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_match_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        x = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        if x and rng.random() < 0.7:
            root = x[: rng.randrange(1, 9)]
            x = (x[: rng.randrange(9)] + root * rng.randrange(1, 9) + x[: rng.randrange(9)]) * rng.choice((1, 2, 4))
        assert periodic.runs_of(x) == runs_by_force(x)
        assert periodic.runs_of(x, 2, 2) == runs_by_force(x, 2, 2)


def test_lyndon_array_is_the_next_smaller_suffix_and_takes_linear_time():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.randrange(2) for _ in range(rng.randrange(30))] * rng.choice((1, 3))
        follow, agree = periodic.lyndon_array(x)
        for i, end in enumerate(follow):
            assert end == next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert end == len(x) or x[end : end + agree[i]] == x[i : i + agree[i]] and x[end + agree[i] : end + agree[i] + 1] != x[i + agree[i] : i + agree[i] + 1]

    class Counted(int):
        times = 0

        def __eq__(self, other):
            Counted.times += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    for x in (b, [0] * 20_000, [rng.randrange(9) for _ in range(2500)] * 8, [rng.randrange(2) for _ in range(20_000)]):
        Counted.times = 0
        periodic.lyndon_array([Counted(v) for v in x])
        assert Counted.times < 4 * len(x)


RUN_TEXTS = [
    (1, "a b c " * 4 + "d"), (2, ""), (3, None), (4, "x " * 6), (5, "x " * 5), (6, "one two three"), (7, "a\tb\na b\x0ba\x0cb a b\r z"), (None, "q q q q q q q"),
    (8, "a a a a a a b " * 4), (9, "ü ü ü ü ü ü"), (4, "x " * 6), (10, " ".join(str(k % 500) for k in range(30_000))), (11, "w" * 100_000 + " " + "v " * 50_000),
]


def run_row(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rank = {w: k for k, w in enumerate(sorted(set(words)))}
    found = sorted(runs_by_force(words) if n < 3000 else periodic.runs_of([rank[w] for w in words]), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_report_on_edge_cases(spark):
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in RUN_TEXTS], "doc_id long, text string, collapsed string, runs int")
    got = sorted((tuple(r) for r in periodic.report(docs).collect()), key=repr)
    assert got == sorted((run_row(k, t) for k, t in RUN_TEXTS), key=repr)
    kept = periodic.collapse(docs)
    assert kept.columns == ["doc_id", "text", "runs", "collapsed"] and kept.filter("doc_id = 1").first().collapsed == "a b c d"
    assert periodic.report(docs.limit(0)).collect() == []


def test_planted_roots(spark):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 300)))) for k in keys]
    got = {r.doc_id: tuple(r) for r in periodic.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: run_row(k, t) for k, t in rows} and sum(r[1] > 0 for r in got.values()) > 5


# Filter interaction


def audit_by_force(docs, labels):
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    fails = []
    for key, text, part in docs:
        t = text or ""
        w = t.encode().split()
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": key is not None and key > least[t]}
        fails.append((part or "", f, any(k == key and k is not None and q == 1 for k, q, _ in labels), any(k == key and k is not None and x == 1 for k, _, x in labels)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [r for r in fails if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                hit = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                total[f] += len(hit)
                out[part, "".join(order), step] = [
                    len(alive), len(hit), sum(r[1][f] for r in own) - len(hit), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_matches_replay_on_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "de"), (2, long, "en"), (1, long, "en"), (None, long, "en"), (3, "", None), (4, None, ""), (5, "ABC $", "de"), (6, long + " #", "fr"),
        (7, "a b " * 80, "en"), (8, long.upper(), "en"), (9, "x" * 200_000, "de"), (None, None, None), (10, "a b " * 80, "fr"), (11, "ü Ü \x0b z", "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (5, 1, 0), (7, None, None), (None, 1, 1), (99, 1, 1), (10, 1, 1)]
    d = spark.createDataFrame([(*r, 3, 4) for r in docs], "doc_id long, text string, lang string, n int, mask int")
    told = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = interaction.audit(interaction.mask_counts(d, told))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == audit_by_force(docs, labels)
    assert interaction.audit(interaction.mask_counts(d.limit(0), told)).collect() == []


def test_shares_are_shapley_values_of_any_filters(spark):
    filters = tuple(interaction.Filter(n, "n_words < 1") for n in "pqrs")
    rng = random.Random(1)
    masks = {m: rng.randrange(50) for m in range(16)}
    counts = spark.createDataFrame([("a", m, n, 0, 0) for m, n in masks.items()], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in interaction.audit(counts, filters).collect()}
    assert len(got) == factorial(4) * 4
    for k, name in enumerate("pqrs"):
        want = sum(Fraction(n, m.bit_count()) for m, n in masks.items() if m >> k & 1)
        assert {Fraction(r.shapley, factorial(4)) for (o, s), r in got.items() if o[s - 1] == name} == {want}


# Main text of pages


PAGE = """<!DOCTYPE html><html><head><title>Head &amp; tail</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav><!-- ad > --><div class="ad big">Buy</div>
<main id="main"><article><header><h1>Ti&shy;tle  of&nbsp;it</h1></header><p>One <b>bo</b>ld &lt;word&gt;<br>next<p class='note'>Two &#65;&#x42; &amp unknown&foo;
<aside>side</aside><form><p>Name <input name=n> <button>Go</button></form><ul><li>li1<li>li2</ul><div class="cookie-notice">We use cookies</div>
<section class="comments" id=c><p>reader says</section><table><tr><td>c1<td>c2</table><footer>by me</footer></article></main><div>after</div><footer>&copy; us</footer></body></html>"""


def text(page):
    return mainhtml.text_of(page, set())


def test_markup_decides_where_it_speaks():
    assert text(PAGE) == "Ti\xadtle of it One bold <word> next Two AB & unknown&foo; li1 li2 c1 c2"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain  text\n only", "plain text only"), ("<p>a<p>b</p>c", "a b c"), ("<article>a <b>b</article> c", "a b"), ("a<!-- x", "a"), ("a <b", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<script>x", ""), ("<article></article><div class=ad>x</div>", ""), ("<ARTICLE>A</ARTICLE>", "A"), ("<p>x&lt;p&gt;y", "x<p>y"), ("<div class='article-comments'>x</div><p>y", "y"),
        ("<article>a<span class=share>tw</span>b</article>", "a b"), ("<div><a href=x>l1</a> <a href=y>l2</a></div><p>t <a href=z>u</a> v w", "t u v w"), ("<p title='a>b'>c</p>", "c"), ("</p></div>a", "a"),
        ("<article>" + "<div>" * 3000 + "deep" + "</article>", "deep"), ("<article><p>" + "w " * 200_000 + "</p></article>", ("w " * 200_000).strip()),
    ],
)
def test_markup_edge_cases(page, want):
    assert text(page) == want


def test_what_a_host_repeats_goes_and_unique_runs_stay(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu, end = "Home News Sport Weather Money Travel", "All rights reserved by the publisher of this site"
    rows, want = [], {}
    for k in range(24):
        own = prose(30)
        rows.append((k, f"http://open.example.org/{k}", f"<div>{menu}</div><div>{own} {end}</div>"))
        want[k] = own
    for k in range(24, 48):
        own, line = prose(20), "A sentence that many articles of this corpus share, some here" if k % 3 == 0 else ""
        rows.append((k, f"http://Marked.example.org/{k}?q", f"<article><p>{own}</p><p>{line}</p><p>Read more stories like this one now</p></article>"))
        want[k] = f"{own} {line}".strip()
    single = prose(25)
    rows += [(48, "http://single.example.org/", f"<div>{menu}</div><p>{single}"), (49, None, None), (None, "", ""), (48, "http://single.example.org/", f"<div>{menu}</div><p>{single}")]
    # Copies of one page are one page of the host.
    rows += [(60 + k, "http://copies.example.org/same", f"<p>{single}") for k in range(9)]
    want |= {48: f"{menu} {single}", 49: "", None: ""} | {60 + k: single for k in range(9)}
    pages = spark.createDataFrame([(*r, "old", 7, 1) for r in rows], "page_id long, url string, html string, text string, n_chars int, bad int")
    got = mainhtml.extract(pages)
    assert got.columns == ["page_id", "url", "html", "bad", "text", "n_chars"] and got.count() == len(rows)
    assert {r.page_id: r.text for r in got.collect()} == want
    assert got.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    assert mainhtml.extract(pages.limit(0)).collect() == []


def test_stretches_are_joined_beyond_the_bound(spark, monkeypatch):
    rows = [(k, "http://h.example.org/", f"<p>One and the same long sentence on all pages. u{k} v{k}") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = {tuple(r) for r in mainhtml.extract(pages).select("page_id", "text").collect()}
    monkeypatch.setattr(mainhtml, "BROADCAST_BYTES", 0)
    assert few == {tuple(r) for r in mainhtml.extract(pages).select("page_id", "text").collect()} == {(k, f"u{k} v{k}") for k in range(12)}
