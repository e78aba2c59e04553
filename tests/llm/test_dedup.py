"""op1, op2 and op8 against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from ledgerframe.llm import jaccard, lines, substrings
from ledgerframe.llm.common import repeated

ODD = [None, "", " \n\t ", "a", "one two three", "x" * 5000, "é" * 300 + "\n" + "é" * 300, "a b c " * 300]


def corpus(seed: int = 1) -> list:
    """Texts with shared passages of many lengths, copies, near copies, repeats inside a text, and odd ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (30, 60, 70, 75, 80, 90, 120, 200, 400)]
    texts = []
    for i in range(60):
        parts = [prose(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), prose(r.randint(0, 60))]
        texts.append(r.choice([" ", "\n"]).join(parts))
    for i in range(15):
        text = list(texts[i])
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = "#"
        texts.append("".join(text))
    return texts + texts[:5] + ODD + ["é" * 300 + "\n" + "é" * 299, "To " * 400, "ab" * 700 + "!" + "ab" * 700]


def removed_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[x:x + length] for b in data for x in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if seen[b[x:x + length]] > 1:
                gone[x:x + length] = b"\1" * length
        out.append((len(b), sum(gone), bytes(c for c, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("size", [2, 3, 7, 10_000])
def test_repeated_keys_that_agree_in_their_first_number(spark, size):
    """Keys are told apart though rows are sorted by their first number alone, at every place where batches end."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 2, 7, 8]) if i < 40 else 100 + i, rng.randrange(12), rng.random() < 0.1, i) for i in range(90)]
    count = collections.Counter(r[:2] for r in rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        df = spark.createDataFrame(rows, "a bigint, b bigint, keep boolean, n int")
        plain = [r["n"] for r in repeated(df, ["a", "b"]).collect()]
        flagged = repeated(df, ["a", "b"], "keep", "leads").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(plain) == [r[3] for r in rows if count[r[:2]] > 1]
    assert sorted(r["n"] for r in flagged) == [r[3] for r in rows if count[r[:2]] > 1 or r[2]]
    leads = collections.Counter((r["a"], r["b"]) for r in flagged if r["leads"])
    assert set(leads.values()) == {1} and set(leads) == {(r["a"], r["b"]) for r in flagged}


@pytest.mark.parametrize("length", [400, 150])
def test_substrings_match_brute_force(docs, length):
    texts = corpus()
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs(texts, extra=True), length=length).collect()}
    want = removed_bytes(texts, length)
    assert sum(w[1] for w in want) > 5000
    for i, w in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == w, i
        assert all(a["end"] < b["start"] for a, b in zip(got[i]["spans"], got[i]["spans"][1:]))


def passage_pairs(n, length, seed=11):
    """Pairs of texts that share one passage; in every thirtieth an anchor stands less than a gram before the passage's end."""
    r = random.Random(seed)
    some = lambda k: "".join(r.choices("abcdefghijklmnop ", k=k))
    out = []
    for i in range(n):
        passage = some(r.randint(length, length + 120))
        tails = [some(60), some(60)]
        if i % 30 == 0:
            back = r.randint(1, substrings.GRAM // 2)
            for j in (0, 1):  # bytes after the passage differ, but leave the place an anchor
                tails[j] = "ab"[j] + some(59)
                while not len(substrings.Text([(passage[-back:] + tails[j][:substrings.GRAM - back]).encode()]).at):
                    tails[j] = "ab"[j] + some(59)
        out += [some(r.randint(0, 90)) + passage + t for t in tails]
    return out


def test_substrings_at_thousands_of_passage_ends(docs):
    length, texts = 150, passage_pairs(1500, 150)  # 3000 texts with a passage start and end each
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs(texts), length=length).collect()}
    want = [w for i in range(0, len(texts), 2) for w in removed_bytes(texts[i:i + 2], length)]
    wrong = [i for i, w in enumerate(want) if (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) != w]
    assert wrong == []


def test_chains_hold_all_bytes_of_their_windows():
    t = substrings.Text([x.encode() for x in passage_pairs(60, 400)])
    reach = t.reach(400)
    held = [i for i in range(len(reach)) if reach[i]]
    assert held and all(t.at[i + reach[i]] >= t.at[i + 1] - 1 + 400 for i in held)


def test_substrings_of_repeated_and_null_rows(docs):
    body = " ".join(f"w{i}" for i in range(200))
    got = substrings.without_repeats(docs([body, body, "short", None, body + "!"], ids=[1, 1, None, None, None])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == sorted(
        [(len(body), len(body))] * 2 + [(5, 0), (0, 0), (len(body) + 1, len(body))])
    assert substrings.without_repeats(docs([])).count() == 0


def kept_lines(texts, ids, min_words):
    """Delete every line of a run of at least ``min_words`` words that stands earlier too, by all pairs of runs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    rows = {}
    for i in order:
        raw = (texts[i] or "").split("\n")
        rows[i] = [(k, x, len(word.findall(x))) for k, x in enumerate(raw) if word.search(x)]
    first, runs = {}, []
    for i in order:
        seq = rows[i]
        for a in range(len(seq)):
            total = 0
            for b in range(a, len(seq)):
                total += seq[b][2]
                if total >= min_words:
                    body = tuple(x for _, x, _ in seq[a:b + 1])
                    runs.append((i, [k for k, _, _ in seq[a:b + 1]], body, (ids[i], a)))
                    first.setdefault(body, (ids[i], a))
                    first[body] = min(first[body], (ids[i], a))
                    if b - a > 40:
                        break
    gone = collections.defaultdict(set)
    for i, found, body, place in runs:
        if place > first[body]:
            gone[i].update(found)
    out = []
    for i, t in enumerate(texts):
        if not gone[i]:
            out.append(t)
            continue
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        out.append(left if word.search(left) else "")
    return out


def line_corpus(seed=3):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abcdef") + str(r.randint(0, 30)) for _ in range(r.randint(1, 6)))
    blocks = [[line() for _ in range(n)] for n in (2, 4, 6, 9)]
    texts = []
    for _ in range(50):
        body = []
        for _ in range(r.randint(1, 4)):
            body += [line() for _ in range(r.randint(0, 4))] + r.choice(blocks)[r.randint(0, 1):]
            body += [""] * r.randint(0, 1)
        texts.append("\n".join(body))
    return texts + texts[:3] + ODD


@pytest.mark.parametrize("min_words", [12, 3])
def test_lines_match_brute_force(docs, min_words):
    texts = line_corpus()
    got = {r["doc_id"]: r for r in lines.without_copies(docs(texts, extra=True), min_words=min_words, out=("kept", "removed")).collect()}
    want = kept_lines(texts, list(range(len(texts))), min_words)
    assert [got[i]["kept"] for i in range(len(texts))] == want
    assert all(got[i]["__kept"] == got[i]["__removed"] == "x" for i in range(len(texts)))
    assert sum(got[i]["removed"] for i in got) > 50


def test_lines_of_odd_tables(docs):
    long = " ".join(["word"] * 60)
    got = lines.without_copies(docs([long, long, long + "\nnew", None], ids=[None, 5, 6, 7])).collect()
    assert {r["doc_id"]: r["__kept"] for r in got} == {None: long, 5: "", 6: "new", 7: None}
    same = lines.without_copies(docs([long, long], ids=[5, 5])).collect()  # equal rows are one text
    assert [r["__kept"] for r in same] == [long, long]
    assert lines.without_copies(docs([])).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)}


def near_corpus(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijkl") + r.choice("xyz") + str(r.randint(0, 40))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 5, 20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            edited = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                edited[r.randrange(len(edited))] = word()
            texts.append(" ".join(edited).upper() if r.random() < 0.2 else "  ".join(edited))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(9)) for _ in range(40)]
    return texts + texts[:6] + ODD


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    lowest = {}
    for i in range(len(texts)):
        lowest[find(i)] = min(lowest.get(find(i), ids[i]), ids[i])
    return [(len(sets[i]), lowest[find(i)]) for i in range(len(texts))]


def test_jaccard_components_match_brute_force(docs):
    texts = near_corpus()
    ids = [7 * i % 1009 for i in range(len(texts))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.linked_components(docs(texts, ids, extra=True)).collect()}
    want = brute_components(texts, ids)
    assert [got[i] for i in ids] == want
    assert len({c for _, c in want}) < len(texts) - 30
    kept = jaccard.representatives(docs(texts, ids, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        i for i, (n, c) in zip(ids, want) if c == i)
    assert kept.columns == docs(texts, ids, extra=True).columns
    assert all(r["__th"] == r["__best"] == r["__key"] == "x" for r in kept.collect())


def test_bucket_counts_never_rule_out_an_overlap():
    rng = np.random.default_rng(3)
    for size, other, same in [(1, 1, 1), (5, 4, 4), (40, 46, 34), (700, 800, 650), (300, 90_000, 250), (90_000, 90_000, 89_000), (60, 60, 0)]:
        both = rng.integers(0, 1 << 63, same, dtype=np.uint64) * np.uint64(2)
        x = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, size - same, dtype=np.uint64))))
        y = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, other - same, dtype=np.uint64))))
        most = jaccard.most_overlap(jaccard.bucket_counts(x), jaccard.bucket_counts(y))
        assert most >= len(np.intersect1d(x, y))
        assert jaccard.most_overlap(jaccard.bucket_counts(x), jaccard.bucket_counts(x)) >= len(x)
    crowded = np.arange(5000, dtype=np.uint64)  # all in one bucket: counts beyond a byte
    assert jaccard.most_overlap(jaccard.bucket_counts(crowded), jaccard.bucket_counts(crowded[::2])) >= 2500
    far = [jaccard.bucket_counts(np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64))) for _ in range(2)]
    assert jaccard.most_overlap(*far) < 0.9 * 400


def test_jaccard_group_of_several_components(docs, monkeypatch):
    # one order for all shingles, so that sets with the same low hashes fall into one group
    monkeypatch.setattr(jaccard, "_common", lambda counts: np.zeros(len(counts), np.uint8))
    pool = [f"word{i}" for i in range(600)]
    low = {w: int(s[0]) for w, s in zip(pool, jaccard.shingle_sets([w.encode() for w in pool], 1))}
    order = sorted(pool, key=low.get)
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(12):  # chains of three, two words changed at each step; the ends of a chain need not link
        rest = list(rng.choice(order[9:], 31, replace=False))
        for _ in range(3):
            sets.append(frozenset(order[:9] + rest))
            rest = rest[2:] + [w for w in rng.permutation(order[9:]) if w not in rest][:2]
    texts = [" ".join(rng.permutation(sorted(s))) for s in sets] + [" ".join(sorted(sets[0]))]
    sets.append(sets[0])
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(len(sets)):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                one, other = parent[a], parent[b]
                parent = [min(one, other) if p in (one, other) else p for p in parent]
    order_table = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    groups = jaccard._prefixes(docs(texts), "doc_id", "text", 1, 85, order_table).select("grp").distinct().count()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(docs(texts), width=1).collect()}
    ids = sorted(got)
    assert groups == 1 and len(set(parent)) >= 12
    assert [got[i] for i in ids] == [ids[p] for p in parent]


def test_jaccard_of_odd_tables(docs):
    body = " ".join(f"w{i}" for i in range(50))
    rows = docs([body, body, body, None, "", None], ids=[None, 4, 4, None, 9, 8])
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"] or -1) for r in
                 jaccard.linked_components(rows).collect())
    assert got == [(-1, 0, -1), (-1, 47, 4), (4, 47, 4), (4, 47, 4), (8, 0, 8), (9, 0, 9)]
    kept = jaccard.representatives(rows).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == [(-1, ""), (4, body), (8, ""), (9, "")]
    assert jaccard.linked_components(docs([])).count() == 0 and jaccard.representatives(docs([])).count() == 0
