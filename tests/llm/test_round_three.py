"""Conversation tries, main texts and collocations against brute force; joins whose ids repeat."""

import hashlib
import html
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from planeframe.llm import caps, lm_context, main_text, ngram_join, phrases, prefix_trie

# --- 11 conversation prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaf = [q for q in under if not any(len(r) == len(q) + 1 and r[:-1] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if whole[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def conversations(seed):
    rnd = random.Random(seed)
    says = ["hello", "", None, "né", "a, b", "long " * 40]
    starts = [[(rnd.choice(["user", "assistant", None]), rnd.choice(says)) for _ in range(9)] for _ in range(2)]
    rows = []
    for c in rnd.sample(range(60), 34):
        start = rnd.choice(starts)[: rnd.randint(0, 9)]
        turns = start + [(rnd.choice(["user", "tool"]), rnd.choice(says)) for _ in range(rnd.randint(0 if start else 1, 6))]
        numbers = list(range(len(turns)))
        if rnd.random() < 0.3:
            numbers[0] = None
        rows += [(c, n, r, t) for n, (r, t) in zip(numbers, turns, strict=True)]
    rows += rows[:3] + [(7, 1, "user", "tie"), (7, 1, "user", "another tie"), (7, 1, None, "tie"), (None, 0, "user", "of no one"), (10**12, 3, "user", "far")]
    rows += [(55, k, "user", f"turn {k % 3}") for k in range(40)] + [(56, k, "user", f"turn {k % 3}") for k in range(40)]
    rnd.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "block", "keys", "nodes"), [(1, 4096, -1, -1), (2, 3, -1, -1), (3, 4, 1, 7)])
def test_prefix_trie(spark, monkeypatch, seed, block, keys, nodes):
    """Also in blocks of few turns, and with keys and fingerprints so short that most groups hold different prefixes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, 9) for r in rows], CONV + ", depth int").repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(table, keys, nodes).collect()]
    want = brute_trie(rows)
    assert sorted(got, key=lambda x: x[:2]) == want
    assert sum(x[3] > 1 for x in want) > 10
    if seed == 1:
        assert prefix_trie.prefix_trie(table.where("false")).count() == 0
        alone = spark.createDataFrame([(3, None, None, None)], CONV)
        assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(alone).orderBy("depth").collect()] == [tuple(x)[:7] for x in brute_trie([(3, None, None, None)])]


# --- 12 main text


def layout(kind, paragraphs, rnd):
    """A page of one of three layouts around known paragraphs, written carelessly."""
    noise = lambda n: " ".join(rnd.choice(["menu", "offer", "click", "news", "best"]) for _ in range(n))
    said = [html.escape(p, quote=rnd.random() < 0.5).replace(" ", rnd.choice([" ", "\n  ", " "])) for p in paragraphs]
    head = f"<!DOCTYPE html><HTML><head><title>{noise(4)}</title><script>if (a<b) document.write('<p>{noise(9)}</p>')</script><style>p > a {{}}</style></head>"
    nav = f"<nav><ul>{''.join(f'<li><a href=/{i}>{noise(2)}</a>' for i in range(6))}</ul></nav>"
    foot = f"<footer><p>&copy; {noise(30)}</p></footer>"
    if kind == 0:
        body = "".join(f"<p>{s[: s.rfind(';') + 1]}<b>{s[s.rfind(';') + 1 :]}</b>" for s in said)
        return f"{head}<body class='x'>{nav}<!-- <article>{noise(50)}</article> --><div class=\"ad\">{noise(20)}.</div><article class=main>{body}</article>{foot}"
    if kind == 1:
        body = "".join(f"<p class=t{rnd.randint(1, 99)}>{s}</p>\n" for s in said[:-1]) + f"<aside><p>{noise(60)}</p></aside><blockquote>{said[-1]}</blockquote>"
        comments = f"<div id='comments'><h3>3 Comments</h3>{''.join(f'<article class=comment><p>{noise(80)}.</p></article>' for _ in range(3))}</div>"
        return f"{head}<body><div id=page><div class='site-header'><h1>{noise(2)}</h1>{nav}</div><div class='col-{rnd.randint(1, 9)} text'>{body}</div><div class='sidebar'><p>{noise(90)}</p></div>{comments}<form><p>{noise(40)}<input name=q></form></div>{foot}</body></html>"
    body = "".join(f"<p>{s}" for s in said)
    plain = f"<div class='box{rnd.randint(1, 99)}'>{noise(rnd.choice([5, 5, 5, 900]))}</div>"  # nothing tells it apart but the host's other pages
    return f"{head}<body><table><tr><td class=left>{plain}<td class='body'>{body}</table><div class='cookie-notice'>{noise(30)}</div></body>"


def test_main_text(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        kind = i % 3
        paragraphs = [" ".join(rnd.choice(["alpha", "bêta", "x < y", "AT&T", '"q"', "zwölf,"]) for _ in range(rnd.randint(8, 60))) + "." for _ in range(rnd.randint(3, 6))]
        rows.append((i, f"http://{['a.example', 'B.example:80', 'u@c.example'][kind]}/{i}?x", layout(kind, paragraphs, rnd), "clash"))
        want[i] = "\n\n".join(paragraphs)
    odd = [(200, None, None), (201, "", ""), (202, "no address", "plain <b>text</b> &amp; more"), (203, "http://", "<p>unclosed <i>tag"), (204, "x", "<nav>only menus</nav>"), (205, "x", "a < b <"), (None, "y", "<p a='"), (202, "twice", "<p>twice</p>")]
    table = spark.createDataFrame(rows + [(*r, "clash") for r in odd], "page_id long, url string, html string, host string").repartition(4)
    got = main_text.main_text(table).collect()
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 200}
    assert by == want
    rest = {(r["page_id"], r["url"]): r["text"] for r in got if r["page_id"] is None or r["page_id"] >= 200}
    assert rest == {(200, None): "", (201, ""): "", (202, "no address"): "plain text & more", (203, "http://"): "unclosed tag", (204, "x"): "", (205, "x"): "a < b <", (None, "y"): "", (202, "twice"): "twice"}
    assert main_text.main_text(table.where("false")).count() == 0


def test_votes_of_the_host_matter():
    """A page that alone would be read wrongly is read as the host's others are; one of another kind goes by its own vote."""
    page = main_text.Page("<body><div class=c><p>" + "own words here, " * 9 + "</p></div><div class=z>" + "noise. " * 99 + "</div>")
    own, noise = ("own words here, " * 9).strip(), ("noise. " * 99).strip()
    assert page.vote() == "body>div.z"
    assert page.article({"body>div.c": 30, "body>div.z": 6, "body": 2}) == own
    assert page.article({"body": 30, "body>div.c": 5}) == own
    assert page.article({"body": 300, "body>div.c": 5}) == f"{own}\n\n{noise}"
    assert page.article({"body": 300}) == page.article({"body>main": 7}) == page.article({}) == noise


@pytest.mark.parametrize("open_", ["<div>", "<p><td>", "<b>", "<a href='", "<!--", "<ul><li>", '<p a="'])
def test_pages_are_read_in_linear_time(open_):
    main_text.Page(open_ * 40_000 + "x" + "</div>" * 40_000)


def test_blocks_and_references():
    said = [b[1] for b in main_text.Page("<p>a&nbsp;b&#233;&amp;lt; c<br>d<br> <br>e<td>f</p>g<h2>T<i>U</i></h2>h<!--x-->i<script>y</script>j<li>k<li>l").blocks]
    assert said == ["a bé&lt; c d", "e", "f", "g", "TU", "hij", "k", "l"]


# --- 13 collocations


def brute_collocations(rows, least, inside, top):
    lists = defaultdict(list)
    for text, lang in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            lists["und" if lang is None else lang].append(re.findall(r"[^\x20\x09]+", piece))
    out = {}
    for lang, pieces in lists.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(w[i : i + k]) for w in pieces for k in range(1, 6) for i in range(len(w) - k + 1))
        have = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in have.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in have.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -score)
    return out


@pytest.mark.parametrize(("width", "inside", "chunk"), [(None, 100, 1 << 21), (64, 60, 500), (1 << 20, 100, 50)])
def test_collocations(spark, monkeypatch, width, inside, chunk):
    """Also with sketches that tell nothing apart, and tasks that hand on often: the result is the same."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "HELD", chunk)
    rnd = random.Random(8)
    vocab = ["a", "B", "b", "né", "x" * 300, "日本", "c\x01d", "e\x1cf", "\xa0", "the", "of", *(f"w{i}" for i in range(30))]
    say = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" "] * 12 + ["\t", " . ", ",", "\n", "  ", "!?"]) for _ in range(n))
    rows = [(say(rnd.randint(1, 60)), rnd.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("New York City Hall is near. " * 3, "en")] * 6 + [(None, "en"), ("", None), (" \t", "fr"), ("one", "it"), ("a a a a a a a a a", "es"), (say(9000), "en"), (say(5000), None), (say(4000), "de")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, phrase int").repartition(3)
    got = phrases.collocations(table, least=9, inside=inside, top=40, width=width)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = {(r["lang"], r["rank"]): tuple(r)[2:] for r in got.collect()}
    want = brute_collocations(rows, 9, inside, 40)
    assert got == want and len(want) > 60
    if width is None:
        assert phrases.collocations(table.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    """The product of counts passes 64 bits; floors stay exact."""
    a, n = 3_000_000_000_000, 90_000_000_000_007
    got = spark.sql(f"select cast((cast(1000 as decimal(38,0)) * {a}L * {n}L) div (cast({a + 1}L as decimal(38,0)) * {a + 3}L) as long)").first()[0]
    assert got == 1000 * a * n // ((a + 1) * (a + 3))


# --- 3 and 8: ids that repeat


@pytest.mark.parametrize("order", [1, -1])
def test_one_id_of_several_texts_joins_their_classes(spark, order):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, near(b)), (5, ""), (9, " ".join(c)), (9, " ".join(c)), (None, near(c)), (None, "words of no one"), (8, None), (4, " ".join(c).upper())][::order]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(table).collect())
    assert got == Counter([(1, 37, 1), (5, 37, 1), (5, 37, 1), (7, 37, 1), (5, 0, 1), (9, 37, 4), (9, 37, 4), (None, 37, 4), (None, 1, None), (8, 0, 8), (4, 37, 4)])


@pytest.mark.parametrize("order", [1, -1])
def test_one_id_of_several_vectors_and_labels(spark, order):
    east, north = [1.0, 0.0, 0.01], [0.0, 1.0, 0.01]
    rows = [(5, east, 1), (5, north, 2), (7, north, 2), (7, [0.02, 1.0, 0.0], 2), (9, east, 2), (9, east, 2), (3, east, None), (None, east, 2)][::order]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = Counter(tuple(r) for r in caps.near_vectors(table).collect())
    assert got == Counter([(5, 0, 5, True), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (9, 2, 9, True), (9, 2, 9, True), (3, 0, 3, True), (None, 2, 9, None)])


def test_keys_that_collide_get_others(spark):
    from pyspark.sql import functions as F

    from planeframe.llm.common import distinct_keys

    table = spark.createDataFrame([(i % 50, i % 7) for i in range(500)], "a long, b long")
    assert table.select(distinct_keys(table, ["a", "b"])).distinct().count() == 350
    with pytest.MonkeyPatch.context() as patch:
        real = F.xxhash64
        patch.setattr("planeframe.llm.common.F.xxhash64", lambda *c: real(*c) if len(c) > 2 else F.col("a") % 5)
        assert table.select(distinct_keys(table, ["a", "b"])).distinct().count() == 350


def test_recall_of_caps_with_many_code_words():
    """Pairs at the limiting cosine meet as well where a label has so many vectors that the code has 10,000 words a block."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.standard_normal((600, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    code = caps.ProductCode(64, words=10_000, depth=caps.DEPTH * (caps.WORDS / 10_000) ** caps.CLOSER)
    met = set()
    for k in range(0, 600, 50):
        a, b = code.decode(x[k : k + 50]), code.decode(y[k : k + 50])
        have = set(zip(*map(np.ndarray.tolist, a), strict=True))
        met |= {k + r for r, f in zip(*map(np.ndarray.tolist, b), strict=True) if (r, f) in have}
    assert len(met) >= 0.98 * len(x)


def test_counting_contexts_needs_little_memory():
    """A task that counts 4 MB of text needs not much more than its tables."""
    texts = MagicMock()
    texts.sparkSession.sparkContext.defaultParallelism = 1
    lm_context.follow_tables(texts)
    run = texts.where.return_value.select.return_value.coalesce.return_value.mapInArrow.call_args.args[0]
    rnd = random.Random(3)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{rnd.randrange(3000)}" for _ in range(7000)) for _ in range(100)]})
    tracemalloc.start()
    parts = sum(len(b) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts > 0
    assert peak < 120 << 20
