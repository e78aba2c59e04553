"""op3, op4, op5, op6 and op7 against brute force, libraries and hand-made cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm import bpe, extraction, fingerprints, licenses, mixing
from ledgerframe.llm.queries import tokenizer_path

ODD = [None, "", " \n\t ", "a", "one two three", "x" * 5000, "é" * 300 + "\n" + "é" * 300, "a b c " * 300]


# ---------------------------------------------------------------- licences

LICENSED = ODD + [
    "Released under the MIT License.", "mit-license MIT  LICENSE", "the gnu general public licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. apache license apache license",
    "GNU Lesser General Public License v2.1 and GNU General Public License v2", "SPDX-License-Identifier: BSD-3-Clause",
    "permit license", "cc by cc by", "über MIT License größe",
]


def base_places(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(found)


def test_license_base_matches_brute_force(docs):
    got = {r["doc_id"]: r for r in licenses.scanned(docs(LICENSED, extra=True), ["doc_id"], "text").collect()}
    for i, text in enumerate(LICENSED):
        n, found = base_places(text)
        r = got[i]
        places = [p for p, _ in found]
        assert (r["n_words"], r["n_base"]) == (n, len(found)), text
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_a_long_text_full_of_licenses_is_scanned_in_linear_time():
    import time

    scan = licenses.Scanner().scan
    took = []
    for n in (20_000, 160_000):
        text = b"mit license foo " * n
        start = time.perf_counter()
        found = scan(text)
        took.append(time.perf_counter() - start)
        assert found["n_base"] == n and (found["first_word"], found["last_word"]) == (0, 3 * n - 3)
    assert took[1] < 30 * took[0]  # eight times the text; 64 times the work were it quadratic


def test_license_rules_resolve_overlaps():
    scan = licenses.Scanner().scan
    assert scan(b"GNU Lesser General Public License version 2.1")["labels"] == "lgpl-2.1"
    assert scan(b"SPDX-License-Identifier: BSD-3-Clause")["labels"] == "bsd-3-clause"
    assert scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc"
    assert scan(b"licensed under the Apache License, Version 2.0")["labels"] == "apache,apache-2.0"
    assert len(licenses.rules()) > 200


def matches_of(parsed, most=40):
    """Strings that a parsed rule matches: every branch, with and without each optional part."""
    texts = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "BRANCH":
            more = [x for p in arg[1] for x in matches_of(p)]
        elif op == "SUBPATTERN":
            more = matches_of(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            more = ([""] if arg[0] == 0 else []) + (matches_of(arg[2]) if arg[1] else [])
        elif op == "IN":
            more = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif op == "ANY":
            more = ["x"]
        else:  # assertions add no text
            continue
        kept = more if len(texts) * len(more) <= 4000 else more[:most]
        texts = [a + b for a in texts for b in kept]
    return texts


def test_every_match_of_every_rule_passes_its_gate():
    everything = licenses.Scanner()
    words = set(everything.by_gate)
    closed = []
    for rule in licenses.rules():
        one = licenses.Scanner([rule])
        found = 0
        for text in dict.fromkeys(matches_of(re._parser.parse(rule.pattern))):
            line = f" {text} "
            open_ = one.detections(line, words)
            seen = {w for _, w in one.gates.iter(line)}
            found += bool(open_)
            if one.detections(line, seen) != open_:
                closed.append((rule.label, text))
        assert found, rule
    assert closed == []


def test_licenses_by_glued_names_and_spdx_ids():
    scan = licenses.Scanner().scan
    want = {"Released under GPLv2": "gpl-2.0", "gpl3": "gpl-3.0", "LGPLv3": "lgpl", "AGPLv3": "agpl-3.0", "FreeBSD license": "bsd-2-clause",
            "0BSD": "0bsd", "OpenRAIL license": "openrail", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc",
            "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
            "SPDX-License-Identifier: MIT-0": "mit-0", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit",
            "SPDX-License-Identifier: GPL-2.0-only OR MIT": "gpl-2.0,mit", "work at mit and isc": ""}
    assert {t: scan(t.encode())["labels"] for t in want} == want


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_follow_the_next_row(docs):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdeé ") for _ in range(r.randint(0, 900))) for _ in range(40)] + ODD
    ids = [(i * 37) % 1000 for i in range(len(texts))]
    got = {x["doc_id"]: x for x in fingerprints.with_next(docs(texts, ids, extra=True), "doc_id", "text").collect()}
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for here, after in zip(order, order[1:] + order[:1]):
        text, follow, x = texts[here] or "", texts[after] or "", got[ids[here]]
        k = len(text) // 4
        edited = (text[:len(text) - k] + follow[:k]).encode()
        mark = fingerprints.fingerprint
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert x["fingerprint"] == mark(text.encode()) and x["edited_fingerprint"] == mark(edited)
        assert x["near_next"] == fingerprints.likeness(mark(text.encode()), mark(follow.encode()))
        assert 0 <= x["near_edited"] <= 1


def test_fingerprints_of_odd_tables(docs):
    one = fingerprints.with_next(docs(["abcdefgh"]), "doc_id", "text").collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.with_next(docs([]), "doc_id", "text").count() == 0
    assert fingerprints.with_next(docs(["a"] * 5, ids=[None, None, 1, 1, 1]), "doc_id", "text").count() == 5


def slow_counts(data):
    counts = [0] * fingerprints.BUCKETS
    m = 0xFFFFFFFF
    for a, b, c, d in zip(data, data[1:], data[2:], data[3:]):
        for h in ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & m,
                  ((a * 0x9E3779B1 + b * 0x85EBCA77 + d * 0xC2B2AE3D) & m) ^ 0x5BD1E995,
                  (a * 0x9E3779B1 + c * 0x85EBCA77 + d * 0xC2B2AE3D) & m):
            h ^= h >> 15
            counts[(h * 0x2C1B3C6D & m) >> 25] += 1
    return counts


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_fingerprint_matches_brute_force(a, b):
    assert fingerprints._counts(a).tolist() == slow_counts(a)
    x, y = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert fingerprints.difference(x, x) == 0 and fingerprints.difference(x, y) == fingerprints.difference(y, x)
    assert 0 <= fingerprints.difference(x, y) <= fingerprints.BOUND


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe._read_spec(tokenizer_path())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=40), st.text(alphabet=" \t\n  ab1'sSt.,<|endoftext|>　\x1c\x85", max_size=60),
    st.just("<|endoftext|>"), st.from_regex(r"[a-z]{1,40}", fullmatch=True)), max_size=6))
def test_encoding_equals_the_library(library, encoder, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    n, packed, decoded = encoder.encode([text])[0]
    assert list(struct.unpack(f"<{n}I", packed)) == ids
    assert decoded.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_encoding_over_a_table(docs, library):
    texts = ODD + ["<|endoftext|> a<|endoftext|>", "don't  stop\n\n now", "ab" * 20000]
    got = {r["doc_id"]: r for r in bpe.encoded(docs(texts, extra=True), ["doc_id"], "text", tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["decoded"] == (t or "") and got[i]["n_tokens"] == len(got[i]["ids"])
    assert bpe.digests(docs([]), ["doc_id"], "text", tokenizer_path()).count() == 0


# ---------------------------------------------------------------- pages

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>%s'
        '<div class="cookie-notice">We use cookies</div><section id="comments"><p>First!</p></section>'
        '<form><p>Name</p></form><footer>&copy; us</footer></body></html>')


@pytest.mark.parametrize("body, want", [
    ("<article><h1>A &amp; B</h1><p>one\n two<b> three</b></p><p>four<br>five</p></article>", "A & B\none two three\nfour five"),
    ("<article><p><b>open<br><p>next</p><aside>side</aside><p>end</article>", "open\nnext\nend"),
    ("<main><p>text</p><script>x</script></main>", "text"),
    ("<p>plain</p>", "plain"),
    ("<article><p>a &lt;b&gt; 3 < 4</p></article>", "a <b> 3 < 4"),
    ("<article></article>", ""),
    ("<article><p>kept</p><span style='display:none'>no</span><p>too</p></article>", "kept\ntoo"),
])
def test_article_of_a_page(body, want):
    got = extraction.article_text(PAGE % body, set())
    assert got == want if want else got in ("",)


@pytest.mark.parametrize("body", [
    '<article class="post has-sidebar"><h1>A</h1><p>long enough text</p></article>',
    '<div class="content comments-open"><h1>A</h1><p>long enough text</p></div>',
    '<div id="social-story"><h1>A</h1><p>long enough text</p></div>',
    '<div class="widget"><article><h1>A</h1><p>long enough text</p></article></div>',
    '<article class="promo"><h1>A</h1><p>long enough text</p></article>',
    '<article><h1>A</h1><p>long enough text</p><div class="share-buttons">Tweet</div></article>',
])
def test_names_do_not_cut_the_main_text(body):
    assert extraction.article_text(PAGE % body, set()) == "A\nlong enough text"


def test_template_of_a_host_is_left_out(spark):
    page = lambda i: (f"<html><body><div>Site name</div><div><p>story {i} of the day</p><p>more {i * i}</p></div>"  # noqa: E731
                      f"<div>About us</div></body></html>")
    rows = [(i, f"http://Host.example/{i}", page(i)) for i in range(6)]
    rows += [(90, "http://lone.example/", "<p>only</p>"), (91, None, "<p>no host</p>"), (92, "http://host.example/x", None), (93, "http://host.example/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extraction.extracted(pages, ["page_id", "url"]).collect()}
    assert len(got) == 10
    for i in range(6):
        assert got[i]["text"] == f"story {i} of the day\nmore {i * i}"
    assert [got[k]["text"] for k in (90, 91, 92, 93)] == ["only", "no host", "", ""]
    assert extraction.extracted(pages.limit(0), ["page_id"]).count() == 0


def test_template_inside_articles_and_articles_in_parts(spark):
    page = lambda i: (f"<html><body><article><h1>Head {i}</h1><p>story {i}</p><div class='x'>Support us</div></article>"  # noqa: E731
                      f"<article><p>part two of {i}</p></article></body></html>")
    copies = "<html><body><article><p>the same</p></article></body></html>"
    rows = [(i, f"http://host.example/{i}", page(i)) for i in range(6)] + [(i, f"http://copies.example/{i}", copies) for i in (10, 11, 12)]
    got = {r["page_id"]: r["text"] for r in extraction.extracted(
        spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {i: f"Head {i}\nstory {i}\npart two of {i}" for i in range(6)} | {i: "the same" for i in (10, 11, 12)}


def test_all_data_slots_of_a_page_without_article(spark):
    page = lambda i: (f"<html><body><div>Site name</div><div class='a'><h1>Head {i}</h1><div class='lead'>Lead {i}</div>"  # noqa: E731
                      f"<div class='b'><p>first {i}</p><div class='mid'>Read on</div><p>second {i}</p></div></div>"
                      f"<div>About us</div></body></html>")
    rows = [(i, f"http://host.example/{i}", page(i)) for i in range(6)]
    got = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Head {i}\nLead {i}\nfirst {i}\nsecond {i}" for i in range(6)}


def test_classes_keep_their_order_and_nest():
    classes = [(9, [1, 2, 3, 4]), (5, [7, 8]), (5, [5, 6])]
    assert extraction.standing([1, 2, 3, 4], classes) == {1, 2, 3, 4}
    assert extraction.standing([1, 3, 4, 2], classes) == {1, 3, 4}
    assert extraction.standing([1, 7, 8, 2, 3, 4], classes) == {1, 2, 3, 4, 7, 8}
    assert extraction.standing([1, 7, 2, 8, 3, 4], classes) == {1, 2, 3, 4}
    assert extraction.standing([1, 2, 6, 5, 3, 4], classes) == {1, 2, 3, 4}
    assert extraction.standing([], classes) == set()


# ---------------------------------------------------------------- mixing


def targets(sizes):
    """Share out, cap, share the excess again until nothing is left over."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        level = {s: (budget - sum(capped.values())) * weight[s] / total for s in open_} if total else {}
        over = [s for s in open_ if level[s] > 2 * sizes[s]]
        if not over:
            return capped | level
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(docs):
    r = random.Random(4)
    texts = ODD + [" ".join("w" for _ in range(r.randint(0, 40))) for _ in range(600)]
    sources = [r.choice(["a", "B", "c", None, "é"]) if i % 3 else "hot" for i in range(len(texts))]
    rows = mixing.copies(docs(texts, sources=sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    assert len(rows) == len(texts)
    taken = {}
    for x in rows:
        assert x["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or ""))
        assert x["__source_size"] == sizes[x["source"]] and math.isclose(x["__target"], want[x["source"]], rel_tol=1e-9)
        assert 0 <= x["__copies"] <= 2
        taken[x["source"]] = taken.get(x["source"], 0) + x["__copies"] * x["__size"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 900  # the words of the largest text
    again = {(x["doc_id"], x["__copies"]) for x in mixing.copies(docs(texts, sources=sources)).collect()}
    assert again == {(x["doc_id"], x["__copies"]) for x in rows}
    clashing = docs(texts, sources=sources, extra=True)
    mix = mixing.mixed(clashing)
    assert mix.columns == clashing.columns and mix.where("__size = 'x' AND __rate = 'x' AND part = 'x' AND size = 'x'").count() == mix.count()
    assert mix.count() == sum(x["__copies"] for x in rows)
    assert mixing.mixed(docs([])).count() == 0 and mixing.mixed(docs([None, ""])).count() == 0


# ---------------------------------------------------------------- pages: what must stay and what must go


def _site(spark, bodies, host="h.example"):
    rows = [(i, f"http://{host}/{i}", f"<html><body><nav>Home About</nav>{b}<footer>(c) us</footer></body></html>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extraction.extracted(df, ["page_id"]).collect()}


def test_copies_of_an_article_do_not_vote_it_away(spark):
    body = "<article><h1>Title</h1><p>The whole long story of the day.</p><p>Its end, with more words.</p></article><div>visit number {}</div>"
    got = _site(spark, [body.format(i) for i in range(4)] + ["<article><p>Another one, quite different.</p></article><div>visit number 9</div>"])
    assert [got[i] for i in range(4)] == ["Title\nThe whole long story of the day.\nIts end, with more words."] * 4
    assert got[4] == "Another one, quite different."


def test_repeated_subheads_stay_and_repeated_notices_go(spark):
    page = ("<article><h1>Dish {0}</h1><h2>Ingredients</h2><p>{0} eggs and {0} spoons of flour.</p><h2>Method</h2><p>Stir {0} times, then bake.</p>"
            "<div class=x>This site uses small cakes.</div></article>")
    got = _site(spark, [page.format(i) for i in range(2, 9)])
    assert got[0] == "Dish 2\nIngredients\n2 eggs and 2 spoons of flour.\nMethod\nStir 2 times, then bake."


def test_elements_within_a_line_do_not_part_it():
    for inner in ("one <img src=a> two", "one <svg><text>x</text></svg> two", "one <picture><source><img></picture> two",
                  "one <script>var a = '<p>';</script> two"):
        assert extraction.article_text(PAGE % f"<p>{inner}</p>", set()) == "one two"
    assert extraction.article_text(PAGE % "<p>foo<wbr>bar</p>", set()) == "foobar"


def test_forms_reader_comments_and_cards():
    text = "<p>A long first paragraph of the page.</p><p>A second one, just as long.</p>"
    assert extraction.article_text(f"<body><form><nav>menu</nav><div class=content>{text}</div></form></body>", set()).count("\n") == 1
    assert extraction.article_text(f"<body><form><p>Search</p></form><article>{text}</article></body>", set()).count("\n") == 1
    for name in ("reader-comments", "user-reviews", "article-comments", "sidebar-right-hand"):
        page = f"<article>{text}<div class='{name}'><p>zap!</p></div></article>"
        assert "zap" not in extraction.article_text(page, set()), name
    for name in ("has-sidebar", "comments-open post", "content comments-open"):
        assert extraction.article_text(f"<article class='{name}'>{text}</article>", set()).count("\n") == 1
    card = "<article><a href=x>Another story to read</a> now</article>"
    assert "Another" not in extraction.article_text(f"<article>{text}</article>{card}", set())


def test_pages_with_columns_of_other_names_repeated_rows_and_long_texts(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a/1", long), (1, "http://a/1", long), (None, None, None), (2, "http://a/2", ""), (3, "no url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "classes", "__host", "__html", "__classes", "text", "n_chars", "token", "pages"):
        df = df.withColumn(name, F.lit("x"))
    got = extraction.extracted(df, ["page_id", "url"]).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted(
        [(1, len("\n".join(f"paragraph {i} of a very long page" for i in range(20_000))))] * 2 + [(0, 0), (2, 0), (3, 1)])
