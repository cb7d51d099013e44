import random
import re

from sigflow.llm import licenses as L

MIT = L.TEMPLATES["mit-text"]
ROWS = [(0, None), (1, ""), (2, "mit"), (3, "The MIT License, mit\nlicense"), (4, "apache-license general PUBLIC license"),
        (5, "general public x license mit licenses"), (6, MIT), (7, MIT.replace("charge to", "charge x to")),
        (8, " ".join(MIT.split()[:6])), (9, "mit license " * 3000), (None, "All Rights Reserved"), (3, "The MIT License, mit\nlicense"),
        (10, "MÍT license é mit license"), (11, "all rights reserved " + MIT)]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(w))
             if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def full(text, templates=None):
    """(labels, score, spans) by the rule, hit by hit."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score, spans = set(), 0.0, 0
    named = [(v, k.split(), True) for k, v in L.PHRASES.items()] + [(k, v.split(), False) for k, v in (templates or L.TEMPLATES).items()]
    for label, t, base in named:
        size = len(t) - 1
        slack = 0 if base else min(L.SLACK, size // 4)
        hits = {(p - q, q) for p in range(len(w) - 1) for q in range(size) if w[p:p + 2] == t[q:q + 2]}
        last = None
        for start in sorted({d for d, _ in hits}):
            top, n = -10**9, 0
            for q in range(size):
                on = [d for d in range(start, start + slack + 1) if (d, q) in hits]
                if on and q + on[0] > top:
                    top, n = q + on[0], n + 1
            if n == size if base else n >= L.LEAST_SHARE * size:
                labels.add(label)
                score = max(score, n / size)
                spans += not base and (last is None or start - last > slack)
                last = start
    return ",".join(sorted(labels)), score, spans


def test_base_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, label string, at int")
    got = L.scan_licenses(df).collect()
    want = [(i, *brute(t)) for i, t in ROWS]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:6]) for r in got)
    assert sorted((repr(i), *full(t)) for i, t in ROWS) == sorted((repr(r.doc_id), r.labels, r.score, r.n_spans) for r in got)
    labels = {(r.doc_id, r.labels, round(r.score, 2)) for r in got}
    assert {(6, "mit-text", 1.0), (11, "mit-text,reserved", 1.0), (8, "", 0.0), (None, "reserved", 1.0)} <= labels
    inserted = next(r for r in got if r.doc_id == 7)     # one more word: two neighbouring diagonals of one span
    assert inserted.labels == "mit-text" and inserted.n_spans == 1 and inserted.score < 1
    assert L.scan_licenses(df.limit(0)).collect() == []


def test_a_repeated_gram_is_no_template(spark):
    texts = ["4.0, 4.0, 4.0, 4.0", "2.0 2.0 2.0 2.0 2.0", "all rights, all rights", "licensed under cc by nc 4.0 4.0 4.0"]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].labels, got[i].score, got[i].n_spans) for i in range(3)] == [("", 0.0, 0)] * 3
    assert (got[3].labels, got[3].score, got[3].n_spans) == ("cc-by-nc-line", 1.0, 1)
    long = " ".join(f"w{i}" for i in range(150))                 # more places than a mask has
    df = spark.createDataFrame([(0, long), (1, " ".join(long.split()[:80])), (2, "w0 w1 " * 200)], "doc_id long, text string")
    assert {(r.doc_id, r.labels) for r in L.scan_licenses(df, templates={"long": long}).collect()} == {(0, "long"), (1, ""), (2, "")}


def scan(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.labels, r.score, r.n_spans) for r in L.scan_licenses(df, **more).collect()}


def test_grams_out_of_order_are_no_template(spark):
    grams = [" ".join(MIT.split()[i:i + 2]) for i in range(len(MIT.split()) - 1)]
    texts = ["rights reserved, all rights", " , x ".join(reversed(grams)), " ".join(reversed(grams)),
             "4.0, 4.0, 4.0, 4.0", "all rights, all rights", "under the mit license, released under",
             " ".join(w + " x x" * (i % 4 == 3) for i, w in enumerate(MIT.split()))]
    got = scan(spark, texts)
    assert [got[i][0] for i in range(5)] == [""] * 5
    assert got[5] == ("mit,mit-line", 1.0, 1)              # the base phrase; 3 of 4 places of the line in order
    assert got == {i: full(t) for i, t in enumerate(texts)}


def test_whole_texts_random_edits(spark):
    rng = random.Random(4)
    texts = []
    for label, t in L.TEMPLATES.items():
        w = t.split()
        for share in (0.0, 0.05, 0.2, 0.6):
            edited = [x for v in w for x in ([] if rng.random() < share / 2 else [v, "zz"] if rng.random() < share else [v])]
            texts.append(" ".join(["intro"] * rng.randint(0, 9) + edited))
    texts.append(" ".join([L.TEMPLATES["mit-full"], "filler " * 30, L.TEMPLATES["mit-full"], "x", L.TEMPLATES["gpl-notice"]]))
    got = scan(spark, texts)
    assert got == {i: full(t) for i, t in enumerate(texts)}
    assert "mit-full" in got[len(texts) - 1][0] and got[len(texts) - 1][2] >= 3
