"""The ten corpus operators against brute force, libraries or held-out labels, and their edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planeframe.llm import caps, licenses, lm_context, lm_scoring, ngram_join, packing, pieces, pii, quality, tokens, toxicity
from planeframe.llm.common import LOWER as LOWER_TABLE
from planeframe.llm.common import Index, Words, components, id_filter, may_hold, mix

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, texts, ids=None):
    """Documents with a clashing extra column."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)


@pytest.fixture(scope="module")
def odd():
    """Null, empty, white space, other scripts, repeated lines, a long text, a long word, marks of control."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = [None, "", " \n\t", "one", "two words", "a b c", "日本語 テキスト", "x" * 3000, "a\x01b\x02c \x1c d\xa0e", "l1\nl1\n\nl1\nl2", "!!! ???", say(4000)]
    return base + [say(rnd.randint(3, 120)) for _ in range(40)] + ["THE %%% END $$$ ## " * 20, "Loud WORDS ONLY HERE " * 30, "same line here\n" * 30]


def empty(spark):
    return spark.createDataFrame([], DOC)


# --- kernels


def test_index_and_filter(spark):
    rnd = np.random.default_rng(1)
    h = np.unique(rnd.integers(0, 1 << 63, 3000, dtype=np.uint64))
    h[:50] &= np.uint64(0xFF)
    h = np.unique(h)
    ix = Index(13)
    ix.add(h[:1500])
    ix.add(h[1500:])
    assert (ix.get(h) == np.arange(len(h))).all()
    assert (ix.get(mix(h)) == -1).sum() >= len(h) - 5
    ids = spark.range(1000)
    f = id_filter(ids)
    assert may_hold(f, np.arange(1000)).all()
    assert may_hold(f, np.arange(5000, 9000)).mean() < 0.05


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 330)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 licenses


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0.\ncode", "more code", "text\n\nReleased under the MIT License.", None, "This program is free software: you can redistribute\nit under the terms of the GNU General Public License as published by the\nFree Software Foundation, either version 3 of the License, or any later version", "All rights reserved. But then the words go on and on about other things", ""]
    paths = ["a/b/0.txt", "a/b/c/1.txt", "a/2.txt", None, "a/b/d/4.txt", "z/5.txt", "top.txt"]
    df = docs(spark, texts).join(spark.createDataFrame(list(enumerate(paths)), "i long, path string"), F.col("doc_id") == F.col("i"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.license_scan(df, F.col("path")).collect()}
    assert got == {
        0: ("Apache-2.0", "Apache-2.0", None), 1: (None, "Apache-2.0", "a/b"), 2: ("MIT", "MIT", None), 3: (None, None, None), 4: ("GPL-3.0-or-later", "GPL-3.0-or-later", None), 5: (None, None, None), 6: (None, None, None),
    }
    assert licenses.license_scan(empty(spark).withColumn("p", F.lit("x/y")), F.col("p")).count() == 0


def test_license_that_most_files_carry(spark):
    """How common a notice is doesn't matter."""
    notice = "Released under the MIT License."
    df = spark.createDataFrame([(i, f"some text {i}\n{notice}" if i % 4 else f"other words {i}", f"d{i}/f") for i in range(40)], "doc_id long, text string, path string")
    for table in (df, df.where("doc_id IN (1, 2, 3)")):
        got = {r["doc_id"]: (r["own_license"], r["own_cosine"]) for r in licenses.license_scan(table, F.col("path")).collect()}
        assert all(v == (("MIT", 1.0) if k % 4 else (None, None)) for k, v in got.items())


def test_license_cosine_matches_definition(spark):
    """The cosine of a line, computed from the definition with counts over all files."""
    texts = ["Licensed under CC BY 4.0.", "licensed work", "under the hood 4", "nothing", "Licensed under the CC BY 4.0"]
    split = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()
    terms = {w for _, t in licenses.TEMPLATES for w in split(t)}
    df = {w: sum(w in split(t) for t in texts) for w in terms}
    idf = lambda w: np.log(6 / (1 + df[w])) + 1 if w in terms else np.log(6) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(split(t)).items()}

    def cos(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    got = {r["doc_id"]: r["own_cosine"] for r in licenses.license_scan(docs(spark, texts), F.concat(F.lit("d/"), F.col("doc_id").cast("string")), cosine=0.3).collect()}
    for i in (0, 4):
        want = max(cos(vec(t), vec(texts[i])) for _, t in licenses.TEMPLATES)
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_license_in_long_lines_and_below_a_title(spark):
    banner = licenses.TEMPLATES[1][1]
    mit = f"The MIT License\n\nCopyright (c) 2020 Someone\n\n{banner}\n"
    rows = [(0, " ".join([banner] * 4), "a/x"), (1, mit, "b/LICENSE"), (2, "code", "b/c/y")]
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert got == {0: ("MIT", "MIT", None), 1: ("MIT", "MIT", None), 2: (None, "MIT", "b")}


def brute_licenses(texts):
    """(license, cosine) of each text by the definition: all lines, two and three lines, and the whole."""
    terms = lambda t: re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", t.translate(LOWER))
    known = licenses.TEMPLATES + licenses.FULL
    vocabulary = {w for _, t in known for w in terms(t)}
    df = Counter(w for t in texts for w in set(terms(t or "")) & vocabulary)
    idf = lambda w: np.log((1 + len(texts)) / (1 + df[w])) + 1 if w in vocabulary else np.log(1 + len(texts)) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(terms(t)).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    models = [(name, vector(t)) for name, t in known]

    def tells(name, m, v):
        marks = {w for f, ws in licenses.SIBLINGS.items() if name.startswith(f) for w in ws.split()}
        digits = {d for d in "1234" if d in m} if name.startswith(licenses.VERSIONED) else set()
        return marks & m.keys() == marks & v.keys() and digits <= v.keys()

    out = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if terms(x)]
        windows = ["\n".join(lines[i : i + k]) for k in (1, 2, 3) for i in range(len(lines) - k + 1)] + [t or ""]
        cosine = lambda v, m: round(sum(x * m.get(w, 0) for w, x in v.items()) / norm(v) / norm(m), 9)
        best = max(((cosine(v, m), -j) for u in windows if (v := vector(u)) for j, (name, m) in enumerate(models) if tells(name, m, v)), default=(0, 0))
        whole = max(((cosine(v, m), -j) for v in [vector(t or "")] if v for j, (name, m) in enumerate(models) if tells(name, m, v) and len(terms(known[j][1])) >= licenses.WHOLE), default=(0, 0))
        best = whole if whole[0] >= licenses.COSINE else best
        out.append((models[-best[1]][0], best[0]) if best[0] >= licenses.COSINE else (None, None))
    return out


@pytest.mark.parametrize("share", [0.25, 1.0])
def test_license_scan_matches_brute_force(spark, share):
    rnd = random.Random(int(share * 4))
    filler = lambda n: " ".join(rnd.choice(["run", "the", "code", "of", "license", "river", "version"]) for _ in range(n))
    mit = "Released under the MIT License."
    texts = [f"{filler(5)}\n{mit}\n{filler(9)}" if i < 24 * share else filler(12) for i in range(24)]
    texts += [mit + " " + filler(3), mit + " " + filler(30), f"{mit} " * 13, "Released under\nthe MIT\nLicense.", licenses.FULL[0][1], "Copyright 2020 A B\n\n" + licenses.FULL[2][1], licenses.FULL[1][1].replace("\n", " "), filler(400) + "\n" + licenses.FULL[3][1]]
    texts += [" ".join(rnd.choice(t.split()) for _ in range(8)) for _, t in licenses.TEMPLATES] + [t for _, t in licenses.TEMPLATES] + [None, "", "\n\n", "All rights reserved", "ALL RIGHTS\nRESERVED!"]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in licenses.license_scan(d, F.concat(F.lit("p/"), F.col("doc_id").cast("string"))).collect()}
    for i, (name, cos) in enumerate(brute_licenses(texts)):
        assert got[i]["own_license"] == name, (i, texts[i], cos)
        assert got[i]["own_cosine"] == (None if cos is None else pytest.approx(cos, abs=2e-6))


LABELLED = [
    ("BSD-2-Clause", licenses.FULL[2][1]), ("BSD-2-Clause", "Copyright (c) 2001, Someone\nAll rights reserved.\n\n" + licenses.FULL[2][1]), ("MIT", "Copyright 2020 X\n\n" + licenses.FULL[0][1]), ("ISC", licenses.FULL[1][1]), ("Zlib", licenses.FULL[3][1]),
    ("BSD-3-Clause", licenses.FULL[2][1].replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED")),
    ("AGPL-3.0-or-later", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."), ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."), ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."), ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007"),
    ("LGPL-2.1-only", "This library is licensed under the GNU Lesser General Public License, version 2.1."), ("LGPL-2.1-or-later", "it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."), ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"), ("Apache-2.0", "// Licensed under the Apache License, Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "licensed under CC BY-NC-SA 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"), ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("MPL-2.0", "Mozilla Public License Version 2.0\n=========="), (None, "Licensed under CC BY-SA 3.0."),
    (None, "This work is licensed under a Creative Commons Attribution 3.0 International License."), (None, "licensed under the Eclipse Public License"), (None, "the GNU project was begun in 1983 by a programmer"), ("Unlicense", licenses.FULL[4][1]), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
]


def test_licenses_are_told_from_their_siblings(spark):
    """Files and notices labelled by hand, among others; unknown licenses and versions give none."""
    texts = [t for _, t in LABELLED] + [f"some other words {i} of a text" for i in range(60)]
    table = spark.createDataFrame([(i, t, f"d{i}/f") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.license_scan(table, F.col("path")).collect()}
    assert [got[i] for i in range(len(texts))] == [n for n, _ in LABELLED] + [None] * 60


# --- 2 quality


def test_quality(spark, odd):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, odd)).collect()}
    assert len(got) == len(odd)
    for i, t in enumerate(odd):
        w = words(t)
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty(spark)).count() == 0
    kept = {r["doc_id"] for r in got.values() if r["kept"]}
    assert {r["doc_id"] for r in quality.only_kept(docs(spark, odd)).collect()} == kept
    assert len(odd) - 3 not in kept
    assert sum(got[i]["kept"] for i in range(12, 52)) >= 10


def test_rule_order_puts_cheap_rejections_first():
    calls = []

    def slow(d):
        for _ in range(2000):
            calls.append(1)
        return True

    order = quality.rule_order(["word other more " + " ".join(f"w{i}x{j}" for j in range(80)) for i in range(20)], {"slow": slow, "never": lambda d: False, "quick": lambda d: True})
    assert order == ["quick", "slow", "never"]


# --- 3 n-gram join


def family(rnd, vocab, n_groups=6, size=7):
    texts = []
    for _ in range(n_groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 150))]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t))
    return texts


def brute_classes(texts, k, t):
    sets = []
    for x in texts:
        w = words((x or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("percent", "blocks"), [(85, 32), (70, 3)])
def test_ngram_join(spark, odd, monkeypatch, percent, blocks):
    """Also with families so small that they are compared in blocks, and trees of few sets."""
    monkeypatch.setattr(ngram_join, "FAMILY", blocks)
    monkeypatch.setattr(ngram_join, "TREE", 4)
    rnd = random.Random(percent)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choice(vocab) for _ in range(60))
    texts = [*odd, *family(rnd, vocab), *(f"{shared} {i} {i + 1} {i * 7}" for i in range(25)), *[shared] * 6, *(f"{i} {shared.upper()}" for i in range(5)), "one", "ONE"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(docs(spark, texts), 4, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, 4, percent)


def test_ngram_join_keeps_links_beside_null_ids(spark):
    """Ids beyond 2**53 stay exact in batches that hold a null id."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) if i else " ".join(base) for i in range(0, 60, 12)] + ["other words of no one"]
    ids = [(1 << 60) + 2 * i + 1 for i in range(5)] + [None]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_classes(docs(spark, texts, ids).coalesce(1)).collect()}
    assert got == {**dict.fromkeys(ids[:5], ids[0]), None: None}


def test_tree_leaves_its_own_group():
    sets = [np.arange(i, i + 20) for i in range(6)]
    tree = ngram_join.Tree(np.zeros(0, np.int64))
    for i, x in enumerate(sets):
        tree.add(x, i, i % 2)
    assert sorted(tree.linked(sets[2], 85, 7)) == [1, 2, 3]
    assert {i for i in tree.linked(sets[2], 85, 0) if i % 2} == {1, 3}


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_classes(empty(spark)).count() == 0


def test_tree():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 25))) for _ in range(60)]
    tree = ngram_join.Tree(sets[0][:0])
    for i, s in enumerate(sets):
        tree.add(s, i)
    for p in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= 60 * len(np.union1d(p, s))]
        assert sorted(tree.linked(p, 60)) == want


# --- 4 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, odd):
    rnd = random.Random(9)
    bits = ["a@b.c", "a.b@c-d.e.f", "@x.y", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "1234567", " ", "é", "_", "@", ".", "+", "-", "5", "\n", "😀", "x@y.z@q.r", "\x01", "\x02m"]
    texts = [*odd, *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(400)), "9" * 20000, "1 " * 8000, "a." * 9000 + "@b.c", "a" * 50000 + " x@y.zz"]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        n = Counter(k for k, _, _ in want)
        r = got[i]
        assert tuple(r[f"n_{k}"] for k in BASE) == tuple(n[k] for k in BASE), t[:80] if t else t
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t[:80]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))
    empty_row = pii.personal_data(docs(spark, [None])).first()
    assert (empty_row["spans"], empty_row["n_email"]) == ("", 0)
    assert pii.personal_data(empty(spark)).count() == 0


def test_personal_data_adds_obfuscated_spans(spark):
    texts = [f"mail us: user{i}@example.com or call +1 (555) 123-45{i:02d} today" for i in range(60)] + ["write to jane.doe (at) example (dot) org now", "no data here at all.Then more"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert got[60] == "email:9:40"
    assert got[61] == ""


DRESS = {
    "email": ["{0} at {1} dot {2}", "{0} [at] {1} [dot] {2}", "{0}(at){1}(dot){2}"],
    "ip": ["{0}[.]{1}[.]{2}[.]{3}", "{0}(.){1}(.){2}(.){3}", "{0}[dot]{1}[dot]{2}[dot]{3}"],
    "card": ["{0}.{1}.{2}.{3}", "{0}_{1}_{2}_{3}", "{0}/{1}/{2}/{3}"],
    "phone": ["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}"],
}


def test_personal_data_in_other_dress(spark):
    """Precision and recall of what the model adds, on texts that it has never seen in this dress."""
    rnd = random.Random(4)
    quad = lambda: "".join(rnd.choice("0123456789") for _ in range(4))

    def card(ok):
        while True:
            p = ["4" + quad()[1:], quad(), quad(), quad()]
            if luhn("".join(p)) == ok:
                return p

    say = lambda: " ".join(rnd.choice(["met", "the", "report", "about", "river", "stone"]) for _ in range(6))
    plain, hidden, decoys = [], {}, {}
    for i in range(300):
        n, ip = rnd.randint(100, 999), [rnd.randint(0, 255) for _ in range(4)]
        ph = [str(rnd.randint(200, 999)), str(rnd.randint(200, 999)), quad()]
        plain.append(f"{say()} u{n}@ex{i}.org and +1 {ph[0]} {ph[1]} {ph[2]} at {ip[0]}.{ip[1]}.{ip[2]}.{ip[3]} or {'-'.join(card(i % 3 > 0))} v{ip[0]}.{ip[1] + 250}.{ip[2]}.{ip[3]} end")
    texts = list(plain)
    for i in range(40):
        for kind, forms in DRESS.items():
            good = {"email": ["ann", f"host{i}", "com"], "ip": [rnd.randint(0, 255) for _ in range(4)], "card": card(True), "phone": [str(rnd.randint(200, 999)), str(rnd.randint(200, 999)), quad()]}[kind]
            bad = {"email": None, "ip": [rnd.randint(256, 999) for _ in range(4)], "card": card(False), "phone": None}[kind]
            for parts, where in ((good, hidden), (bad, decoys)):
                if parts:
                    m, lead = forms[i % 3].format(*parts), say() + " to "
                    where[len(texts)] = f"{kind}:{len(lead)}:{len(lead) + len(m)}"
                    texts.append(f"{lead}{m} {say()}")
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, texts)).collect()}
    found = sum(got[i]["spans"] == want for i, want in hidden.items())
    wrong = sum(got[i]["n_spans"] > 0 for i in decoys)
    assert found >= 0.9 * len(hidden), (found, len(hidden), Counter(w.split(":")[0] for i, w in hidden.items() if got[i]["spans"] != w))
    assert wrong <= 0.02 * len(decoys)
    for i in range(300):
        assert got[i]["n_spans"] == sum(got[i][f"n_{k}"] for k in DRESS)


def test_redaction(spark):
    text = "😀 mail a@b.cd or +1 (555) 123-4567, card 4111 1111 1111 1111."
    out = {r["doc_id"]: r for r in pii.redact(docs(spark, [text, None, "plain"])).collect()}
    assert out[0]["text"] == "😀 mail [EMAIL] or [PHONE], card [CARD]."
    assert (out[1]["text"], out[2]["text"], out[0]["label"]) == (None, "plain", "x")


def test_boosting_separates():
    cells = [(0b01, 50, 1), (0b10, 2, 60), (0b11, 30, 0), (0b00, 0, 5)]
    trees = pii.fit(cells)
    score = {b: sum(pii.value(t, b) for t in trees) for b, _, _ in cells}
    assert score[0b11] > 0 > score[0b10]
    assert score[0b01] > 0 > score[0b00]
    assert pii.fit([]) == []


# --- 5, 6, 7 tokens


@pytest.fixture(scope="module")
def wild(odd):
    rnd = random.Random(11)
    al = "aaab   \n\t'sd1é漢<|>▂\x1c\x85\xa0.,!😀ingonst"
    return [t or "" for t in odd] + ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["<|endoftext|> a <|endoftext|>b <|startoftext|>", "we'll it's 12345", "  " * 40 + "x", "a" * 700]


def test_sentencepiece_matches_library(spark, wild):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.encode_pieces(docs(spark, wild), path)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert [got[i] for i in range(len(wild))] == [lib.encode(t) for t in wild]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(enc, path).collect()}
    assert [back[i] for i in range(len(wild))] == wild
    assert all(r["round_trip"] for r in pieces.piece_digest(docs(spark, wild), path).collect())
    r = pieces.piece_digest(docs(spark, [None, "a▁b"]), path).orderBy("doc_id").collect()
    assert (r[0]["n_pieces"], r[0]["round_trip"], r[1]["round_trip"]) == (0, True, False)
    assert pieces.encode_pieces(empty(spark), path).count() == 0


def test_sentencepiece_of_endless_words():
    """Runs of spaces and words of any length take time in proportion, and give what the library gives."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, lib = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    letters = lambda s, n: "".join(rnd.choice(s) for _ in range(n))
    for t in (" " * 100_000, "a" * 3000, letters("etaoinshr", 120_000), "x" + " " * 5000 + "yz" * 2000, letters("éa日😀 ", 5000), " " * 17 + "ab", letters("etaoin", 1001), "ab" * 50_001):
        began = time.perf_counter()
        assert model.encode([t])[0].tolist() == lib.encode([t], num_threads=1)[0]
        assert time.perf_counter() - began < 20


def test_token_counts_match_library(spark, wild):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in tokens.token_counts(docs(spark, [*wild, None]), path).collect()}
    want = [len(e.ids) for e in lib.encode_batch([*wild, ""], add_special_tokens=False)]
    assert [got[i]["n_tokens"] for i in range(len(want))] == want
    assert [got[i]["n_bytes"] for i in range(len(wild))] == [len(t.encode()) for t in wild]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got.values())
    assert tokens.token_counts(empty(spark), path).count() == 0


def test_memories_start_anew(monkeypatch, wild):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(packing, "MEMO", 64)
    monkeypatch.setattr(pieces, "MEMO", 50)
    import pyarrow as pa
    from tokenizers import Tokenizer

    count = tokens.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(0, 60, 6):
        part = wild[i : i + 6]
        assert count.count(part) == [len(lib.encode(t, add_special_tokens=False).ids) for t in part]
        flat, off = ids.encode(pa.array(part, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [own.encode(t, add_special_tokens=False).ids for t in part]


def best_fit(items, capacity):
    left = []
    for s in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= s]
        i = min(fit, key=lambda i: left[i], default=None)
        if i is None:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= s
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 16, 100])
    items = [rnd.randint(1, capacity) for _ in range(150)]
    at, ranks = defaultdict(list), defaultdict(list)
    for s, rank, n, seq, off in packing.plan(dict(Counter(items)), capacity):
        for j in range(n):
            at[seq + j].append((off, s))
            ranks[s].append(rank + j)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(items).items()}
    for placed in at.values():
        end = 0
        for off, s in sorted(placed):
            assert off == end
            end += s
    assert sorted(capacity - sum(s for _, s in p) for p in at.values()) == best_fit(items, capacity)


def test_packing(spark, wild):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*wild, None, wild[20], wild[20]]
    rows = packing.best_fit_packing(docs(spark, texts, [*range(len(texts) - 1), len(texts) - 2]), path, 64).collect()
    want = []
    for i, t in zip([*range(len(texts) - 1), len(texts) - 2], texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in at.values():
        end = 0
        for off, n in sorted(placed):
            assert off == end
            end += n
        assert end <= 64
    assert len(at) == len(best_fit([w[3] for w in want], 64))
    assert packing.best_fit_packing(empty(spark), path).count() == 0


# --- 8 embeddings


def test_product_code_recall():
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.standard_normal((1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = caps.ProductCode(64)
    a, b = code.decode(x), code.decode(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    have = set(zip(*map(np.ndarray.tolist, a), strict=True))
    met = {r for r, f in zip(*map(np.ndarray.tolist, b), strict=True) if (r, f) in have}
    assert len(met) >= 0.99 * len(x)


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rnd = np.random.default_rng(block)
    base = rnd.standard_normal((12, 16))
    rows = [(b + rnd.normal(0, s, 16)).astype(np.float32).tolist() for b in base for s in (0.01, 0.1, 0.25, 0.35, 0.0, 0.0)]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15, [], [1.0, 0.0], [2.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [1e30] * 16, [1e-30] * 16]
    labels = [int(rnd.integers(0, 2)) for _ in rows]
    labels[3] = None
    for k in (-6, -5, -4, -3, -2, -1):
        labels[k] = 1
    df = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<float>, label int, caps string").repartition(3)

    def usable(i):
        v = rows[i]
        return labels[i] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(rows[i], np.float32).astype(float) / np.linalg.norm(np.array(rows[i], np.float32).astype(float)) for i in range(len(rows)) if usable(i)}
    links = defaultdict(set)
    for i in unit:
        for j in unit:
            if i != j and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect()}
    want = {i: (len(links[i]), reach(i), reach(i) == i) for i in range(len(rows))}
    assert got == want
    assert sum(x[0] for x in want.values()) > 20
    assert caps.near_vectors(df.where("false")).count() == 0


def test_balls_count_as_their_vectors(spark, monkeypatch):
    """Groups of many near vectors at angles around the limit: decided as wholes, member by member, and vector by vector."""
    monkeypatch.setattr(caps, "BLOCK", 7)
    monkeypatch.setattr(caps, "CELL_SIZE", 9)
    rnd = np.random.default_rng(3)
    rows = []
    for turn in (0.0, 0.2, 0.36, 0.5, 1.2):
        centre = np.zeros(32)
        centre[0], centre[1] = np.cos(turn), np.sin(turn)
        rows += [(centre + rnd.normal(0, s, 32)).tolist() for s in (0.002, 0.01, 0.02) for _ in range(12)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_vectors(df).collect()}
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    want = {i: (int(near[i].sum()) - 1, root[i]) for i in range(len(rows))}
    assert got == want
    assert len(set(root)) == 2


# --- 9 language model


def test_lm_scores(spark, odd):
    texts = [*odd, odd[20], "the only one\0 here"]
    ids = [*range(len(odd)), 20, 500]
    rows = lm_scoring.lm_scores(docs(spark, texts, ids), frequent=40).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = [[w.translate(LOWER) for w in words(t)] + [None] for t in texts]
    count = Counter(w for i, t in zip(ids, toks, strict=True) if not held(i) for w in t)
    total, kinds = sum(count.values()), len(count)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in zip(ids, toks, strict=True):
        base = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        for r in by[i]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(count[w] > 0 for w in t), total)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
            assert np.isfinite(r["score"])
            assert r["score"] < 0
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


def test_lm_scores_know_the_order_of_words(spark):
    """A held-out text scores less with its words in another order; every word stands once, so the text's own tokens say nothing."""
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = {i: " ".join(vocab[a : a + 40]) for i in range(400) if (a := rnd.randrange(260)) >= 0}
    mixed = texts[held[0]].split()
    rnd.shuffle(mixed)
    texts[held[1]] = " ".join(mixed)
    score = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs(spark, list(texts.values()), list(texts))).collect()}
    assert score[held[0]] > score[held[1]] + 40


def test_lm_scores_do_not_depend_on_what_is_broadcast(spark, odd):
    d = docs(spark, odd)
    score = lambda n: sorted((r["doc_id"], r["score"], r["base_score"]) for r in lm_scoring.lm_scores(d, frequent=n).collect())
    for a, b in zip(score(1), score(100_000), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def code_stream(codes, contexts=(5, 9)):
    """Texts of one token each, all in the same contexts."""
    n = len(codes)
    s = lm_context.Stream.__new__(lm_context.Stream)
    s.begin = s.ends = s.owner = np.arange(n)
    s.code = np.asarray(codes, np.int32)
    s.hash = s.code.astype(np.uint64) << np.uint64(64 - lm_context.CODE)
    s.contexts = [np.full(n, c << 32, np.uint64) for c in contexts]
    return s


def test_codes_keep_a_distribution():
    """Whatever stands before a token, the probabilities of all codes add up to one."""
    rnd = np.random.default_rng(1)
    n = 1 << lm_context.CODE
    tables = [lm_context.told(rnd.integers(0, 9, (1 << b, 2)), (2, 4)) for b in lm_context.FOLLOW]
    weights = rnd.normal(0, 0.3, (lm_context.GATES, lm_context.INPUTS))
    m = lm_context.CodeMixer(tables, rnd.random(n), weights, np.sort(rnd.random((2, lm_context.GATES * lm_context.STEPS)), axis=0)[::-1] * 100)
    p = 10.0 ** m.log10(code_stream(np.arange(n)), np.ones(n, bool))
    assert p.std() > 0
    assert p.sum() == pytest.approx(1.0)


def test_running_text_is_mixed_as_by_a_plain_model(spark):
    """Counts, deletion of the own occurrence, inputs, gates, mixture, map and cache, one bit at a time with dictionaries for tables."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30))) for _ in range(20)]
    held = np.array([i % 4 == 0 for i in range(20)])
    src = spark.createDataFrame([(t, bool(h)) for t, h in zip(texts, held, strict=True)], "text string, held boolean")
    rng = np.random.default_rng(2)
    mass, weights = rng.random(1 << lm_context.CODE), rng.normal(0.3, 0.3, (lm_context.GATES, lm_context.INPUTS))
    hits = np.sort(rng.random((2, lm_context.GATES * lm_context.STEPS)), axis=0)[::-1] * 100
    m = lm_context.CodeMixer(lm_context.follow_tables(src), mass, weights, hits)
    s = lm_context.Stream(Words(pa.array(texts), LOWER_TABLE))
    got = m.log10(s, held)
    C = lm_context.CODE
    seen = defaultdict(lambda: [0, 0])
    streams = [s.code[b : e + 1].tolist() for b, e in zip(s.begin, s.ends, strict=True)]
    path = lambda c: [(1 << k | c >> (C - k), c >> (C - 1 - k) & 1) for k in range(C)]
    around = lambda t, i: ((t[i - 1],) if i else ("begin",), (t[i - 1], t[i - 2] if i > 1 else "begin") if i else ("begin", "begin"))
    for t, h in zip(streams, held, strict=True):
        for i, c in enumerate(t):
            for node, bit in path(c):
                for ctx in around(t, i):
                    seen[ctx, node][bit] += not h
    below = np.concatenate([np.zeros(1 << C), mass])
    for i in range((1 << C) - 1, 0, -1):
        below[i] = below[2 * i] + below[2 * i + 1]
    want = []
    for t, h in zip(streams, held, strict=True):
        for i, c in enumerate(t):
            total, match = 0.0, next((t[j] for j in range(i - 1, -1, -1) if around(t, j)[1] == around(t, i)[1]), -1)
            for k, (node, bit) in enumerate(path(c)):
                one = below[2 * node + 1] / below[node]
                x, n = [np.log(one / (1 - one))], []
                for ctx in around(t, i):
                    counts = list(seen[ctx, node])
                    counts[bit] -= not h
                    n.append(sum(counts))
                    x.append(np.log(counts[1] + lm_context.PRIOR) - np.log(counts[0] + lm_context.PRIOR))
                fits = match >= 0 and match >> (C - k) == c >> (C - k)
                x += [(2 * (match >> (C - 1 - k) & 1) - 1) if fits else 0.0, 0.3]
                gate = (int(fits) * 3 + sum(n[0] >= v for v in (4, 64))) * 4 + sum(n[1] >= v for v in (1, 2, 4))
                p = 1 / (1 + np.exp(-np.dot(weights[gate], x)))
                at = (np.clip(np.log(p / (1 - p)), -8, 8) + 8) * (lm_context.STEPS - 1) / 16
                lo = min(int(at), lm_context.STEPS - 2)
                odds = [(hits[1][gate * lm_context.STEPS + v] + lm_context.IDENTITY / (1 + np.exp(-(v * 16 / (lm_context.STEPS - 1) - 8)))) / (hits[0][gate * lm_context.STEPS + v] + lm_context.IDENTITY) for v in (lo, lo + 1)]
                p = np.clip((p + odds[0] * (1 - at + lo) + odds[1] * (at - lo)) / 2, 1e-6, 1 - 1e-6)
                total += np.log(p if bit else 1 - p)
            part = lm_context.CACHE * i / (i + lm_context.CACHE_AT)
            want.append(np.log10((1 - part) * np.exp(total) + part * sum(y == c for y in t[:i]) / max(i, 1)))
    assert np.isclose(got, want, atol=2e-2).mean() > 0.97  # all but where two contexts share a slot


def test_spelling_is_a_distribution():
    """The probabilities of all bytes at any place of a token add up to one."""
    vocab = [b"ab", b"abc", b"b", "é".encode(), lm_scoring.END, b"x" * 70]
    tables = [np.zeros((1 << n, 2), np.float32) for n in lm_scoring.TABLES]
    s = lm_scoring.Spelling(vocab)
    for _, bit, slots in s.steps():
        for t, at in zip(tables, slots, strict=True):
            np.add.at(t, (at, bit), 3)
    m = lm_scoring.Mixer(tables)
    m.learn(s, np.full(len(vocab), 3.0))
    cut = lambda t: m.log10([t])[0]

    def first_byte(b):
        """log10 of the first byte alone: the steps of the first eight bits."""
        total = 0.0
        for k, (_, bit, slots) in enumerate(lm_scoring.Spelling([bytes([b])]).steps()):
            if k == 8:
                break
            x, gate = m.inputs(slots)
            p = m.refine(m.mix(x, gate), gate)[0]
            total += np.log10(p if bit[0] else 1 - p)
        return total

    assert sum(10 ** first_byte(b) for b in range(256)) == pytest.approx(1.0)
    assert cut(b"abc") > cut(b"qqq")
    assert cut(b"x" * 70) < 0


# --- 10 toxicity


@pytest.fixture(scope="module")
def insults():
    rnd = random.Random(8)
    syllables = ["ta", "re", "mo", "li", "san", "dor", "vek", "um", "pi", "ola"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    bad = ["idiot", "scumbag", "moron", "worthless"]
    rows = []
    for _ in range(400):
        toxic = rnd.random() < 0.3
        t = [word() for _ in range(rnd.randint(10, 60))]
        if toxic:
            for _ in range(rnd.randint(1, 2)):
                t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        rows.append((" ".join(t), int(toxic)))
    return rows


def gapped(word):
    """Weights of all gapped triples of bytes of a word, by the definition."""
    m, out, norm = [1, *word], Counter(), 0.0
    for i in range(len(m)):
        for k in range(2, toxicity.WINDOW):
            for j in range(1, k):
                if i + k < len(m):
                    w = toxicity.DECAY ** (k - 2)
                    out[m[i], m[i + j], m[i + k]] += w
                    norm += w * w
    return out, norm + 1e-9


def test_kernel_of_gapped_subsequences():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 12))).encode()
    left, right = [word() for _ in range(40)] + [b"stupid", b"st.u.p.i.d"], [word() for _ in range(15)] + [b"stupid", b"lovely"]
    got = toxicity.Landmarks(right).kernel(left)
    want = np.array([[sum(x * b[f] for f, x in a.items()) / np.sqrt(n * m) for b, m in map(gapped, right)] for a, n in map(gapped, left)])
    assert np.isclose(got, want, atol=1e-4).mean() > 0.98  # all but where two triples share a feature
    assert got[-1, -2] > got[-1, -1] + 0.1  # inserted marks leave an insult like itself
    marks = toxicity.Landmarks(right)
    weights = np.random.default_rng(1).normal(size=len(right)).astype(np.float32)
    table = marks.folded(weights)
    assert toxicity.Scorer(table, 0.0).margins(*toxicity._packed(left)) == pytest.approx(got @ weights, abs=1e-3)


def test_pieces_of_long_words():
    w = bytes(rnd.randrange(97, 123) for rnd in [random.Random(3)] for _ in range(200))
    parts = toxicity.pieces(w)
    assert all(len(p) <= toxicity.PIECE for p in parts)
    assert parts[0] + b"".join(p[toxicity.WINDOW :] for p in parts[1:]) == w
    assert toxicity.pieces(b"short") == [b"short"]


def test_toxicity_generalises(insults):
    import pyarrow as pa

    scorer = toxicity.fit(insults[:300])
    held = insults[300:]
    p = scorer.score(scorer.texts(pa.array([t for t, _ in held], pa.string())))
    assert sum((x >= 0.7) == bool(y) for x, (_, y) in zip(p, held, strict=True)) >= 97
    plain = "tare moli sandor um pi ola vekta rere"
    tricks = ["idi.ot", "id*iot", "IDIOT!!", "m-o-r-o-n", "i d i o t", "scum_bag", "wortthless"]
    p = scorer.score(scorer.texts(pa.array([plain, *(f"{plain} {t} {plain}" for t in tricks), "", None, "y" * 20000], pa.string())))
    assert p[0] < 0.3
    assert (p[1:-3] >= 0.5).sum() >= 6
    assert (p[-3:] < 0.5).all()


def test_machine_of_all_everyday_words(insults):
    """The machine that grows its set of everyday words is that of all of them, and the greedy covering that of the plain rule."""
    bag = toxicity.bags([t for t, _ in insults])
    toxic, clean = [b for b, (_, y) in zip(bag, insults, strict=True) if y], [b for b, (_, y) in zip(bag, insults, strict=True) if not y]
    seeds, left, want = toxicity._seeds(toxic, clean), set(range(len(toxic))), Counter()
    pos, neg = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    holds = {w: {d for d, b in enumerate(toxic) if w in b} for w in pos if len(w) > 2 and pos[w] >= 2 and 20 * neg[w] * len(toxic) <= pos[w] * len(clean)}
    while holds and len(holds[best := max(holds, key=lambda w: (len(holds[w] & left), pos[w], w))] & left) >= 2:
        want[best] = len(holds[best] & left)
        left -= holds[best]
    assert seeds == want and seeds
    everyday = sorted({w for b in clean for w in b})
    marks = toxicity.Landmarks([*seeds, *everyday[:30]])
    vals, vecs = np.linalg.eigh(marks.gram())
    keep = vals > 1e-4 * vals.max()
    to = vecs[:, keep] / np.sqrt(vals[keep])
    whole, block = toxicity.BLOCK, 50
    toxicity.BLOCK = block
    try:
        got, value = toxicity._settled(marks, to, seeds, everyday)
    finally:
        toxicity.BLOCK = whole
    strong = np.array([min(n, 20) for n in seeds.values()], float)
    weight = np.concatenate([strong * toxicity.COST * 200 / strong.sum(), np.full(len(everyday), toxicity.CLEAN_COST)])
    z = np.concatenate([marks.kernel([*seeds, *everyday]) @ to, np.ones((len(weight), 1))], axis=1)
    y = np.repeat([1.0, -1.0], [len(seeds), len(everyday)])
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-3)
    for _ in range(60):  # the plain machine: damped Newton steps over all rows
        on = y * (z @ w) < 1
        step = np.linalg.solve(np.diag(ridge) + (z[on].T * weight[on]) @ z[on], (z[on].T * weight[on]) @ (y[on] - z[on] @ w) - ridge * w)
        w += step if np.abs(step).max() < 1e-6 else 0.5 * step
    assert value == pytest.approx((z @ w)[len(seeds) :], abs=2e-2)
    assert got.margins(*toxicity._packed(list(seeds))) == pytest.approx((z @ w)[: len(seeds)], abs=2e-2)


def test_toxicity_on_frames(spark, insults):
    d = docs(spark, [t for t, _ in insults[:200]] + [None, ""])
    lab = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(insults[:200])] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(d, lab)
    out = {r["doc_id"]: r for r in toxicity.toxicity(d, scorer).collect()}
    assert len(out) == 202
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    left = toxicity.without_toxic(d, scorer)
    assert left.columns == d.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in out.items() if not r["predicted"]}
    nobody = toxicity.train(d, lab.where("false"))
    assert toxicity.toxicity(d, nobody).where("score between 0 and 1").count() == 202
    assert toxicity.toxicity(empty(spark), scorer).count() == 0
