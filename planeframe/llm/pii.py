"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Everything on the data's path is a DataFrame expression. Spans are found by one
``regexp_replace`` per pattern, which puts marks around matches; the marked text
is split and positions are summed up from the lengths of its parts.

The trees judge what the base patterns can't see: data in other dress. The
corpus has no labels for that, so it teaches by its own base matches, each put
into such dress where it stands: one that passes the base check is a positive,
one that fails it a negative, and so is a true one after a change that breaks it
or that makes it a part of something longer. Several generators a kind propose
spans that may overlap; the scores choose among them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

KINDS = ("email", "ip", "card", "phone")
_OPEN, _SHUT, _SEAL = "\x01", "\x02", "\x03"
#: Code points before a span that its features see.
BEFORE = 40
SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"
TAKEN = "struct<start:int,end:int,kind:string,margin:double>"

#: Base patterns in linear form: (what a text must hold, match, what is passed over). Possessive loops can't give
#: back what the next part could use, and runs in which no match can begin are passed over, so none is scanned twice.
BASE = {
    "email": (r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]++"),
    "card": (r"(?:[0-9][\x20-]?){12}[0-9]", r"[0-9]++(?:[\x20-][0-9]++)*+", r"(?!)"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"(?!)"),
}

_LEFT, _RIGHT = r"\x20?[\[({<|]\x20?", r"\x20?[\])}>|]\x20?"
_NAME, _LABEL = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_DOT = rf"(?:{_LEFT}(?i:dot|\.){_RIGHT}|\x20(?i:dot)\x20|\.)"
_APART = r"(?:[._/:*|,·–— ]|\x20{2,3}|\x20[-./|–—]\x20)"
_BETWEEN = r"(?:[\x20./·– -]|\x20[-/.–]\x20)"

#: High-recall generators of each kind beyond the base, in the base's form. Those of a kind, and kinds among each
#: other, may propose spans that overlap.
WIDE = {
    "email": [
        (rf"{_LEFT}(?i:at|@){_RIGHT}", rf"{_NAME}{_LEFT}(?i:at|@){_RIGHT}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}", _NAME),
        (r"\x20(?i:at)\x20[A-Za-z0-9-]+\x20(?i:dot)\x20", rf"{_NAME}\x20(?i:at)\x20{_LABEL}(?:\x20(?i:dot)\x20{_LABEL}){{1,4}}", _NAME),
        (r"@\x20|\x20@", rf"{_NAME}(?:\x20@\x20?|@\x20){_LABEL}(?:\.{_LABEL}){{1,4}}", _NAME),
        (r"\x20\.\x20|\x20(?i:dot)\x20", rf"{_NAME}\x20?@\x20?{_LABEL}(?:\x20(?i:dot|\.)\x20{_LABEL}){{1,4}}", _NAME),
    ],
    "ip": [
        (rf"[0-9]{_LEFT}(?i:dot|\.)", rf"[0-9]{{1,3}}(?:(?:{_LEFT}(?i:dot|\.){_RIGHT}|\.)[0-9]{{1,3}}){{3}}", r"(?!)"),
        (r"[0-9]\x20(?i:dot|\.)\x20[0-9]", r"[0-9]{1,3}(?:\x20(?i:dot|\.)\x20[0-9]{1,3}){3}", r"(?!)"),
    ],
    "card": [
        (rf"[0-9]{{4}}{_APART}[0-9]{{4}}", rf"[0-9]{{4}}(?:{_APART}[0-9]{{2,6}}){{2,4}}", r"(?!)"),
    ],
    "phone": [
        (rf"[0-9]{{3}}\)?{_BETWEEN}?[0-9]{{3}}{_BETWEEN}[0-9]{{4}}", rf"(?:\([0-9]{{3}}\)\x20?|[0-9]{{3}}{_BETWEEN})[0-9]{{3}}{_BETWEEN}[0-9]{{4}}", r"(?!)"),
        (r"00[0-9]{1,3}[\x20.()/-]", rf"00[0-9]{{1,3}}(?:[\x20.()/-]{{1,2}}[0-9]{{2,4}}){{2,5}}", r"(?!)"),
    ],
}

#: Words that stand before personal data of each kind.
HINTS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|credit|account|payment)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W{0,4}(?:\w+\W{1,3}){0,2}$",
}
#: How addresses of hosts usually end.
TAILS = r"(?i)[^a-z](?:com|net|org|edu|gov|mil|int|info|biz|[a-z]{2})$"
#: Boolean features of a candidate, in the order of the trees' feature numbers.
FEATURES = ("email", "ip", "card", "phone", "hint", "joined_before", "joined_after", "octets", "brackets", "spaces", "long", "short", "luhn", "alpha_tail", "known_tail", "card_length")
#: Boosting: rounds, depth and rate; a kind's threshold must reach this precision on its held-out candidates.
ROUNDS, DEPTH, RATE, PRECISION = 20, 3, 0.5, 0.98


def _let(value: Column, f) -> Column:
    """``f(value)``, the value computed once."""
    return F.transform(F.array(value), f)[0]


def _blocks(items: Column, f) -> Column:
    """``f(place, size)`` of each of an array's blocks, which are as many as they are long."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, size), lambda at: f(at, size))


def _walk(items: Column, zero: Column, step, kind: str) -> Column:
    """What a walk through an array gives out: ``step(state, item)`` is (next state, whether to give out, what).

    A fold copies what it has collected at each item, so the array is walked in
    blocks that hand on their state: n items cost n ** 1.5 references, not n ** 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        state, gives, what = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(gives, F.concat(acc["out"], F.array(what.cast(kind)))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        walked = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(walked, lambda w: F.struct(w["state"].alias("state"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    def walk(xs: Column) -> Column:
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = _blocks(xs, lambda at, size: F.slice(xs, at + 1, size))
        return F.when(F.size(xs) > 0, F.aggregate(blocks, start, outer, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return _let(items, walk)


def _spans(text: Column, probe: str, match: str, skip: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, m, before, after), code points, end exclusive.

    What stands before a match comes along with the walk and what follows it
    from a look ahead, so no text is cut by place again.
    """
    marked = F.regexp_replace(text, rf"({match})(?=([\s\S]?))|({skip})", f"{_OPEN}$1{_SHUT}$2{_SEAL}$3")
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"))

    def step(state: Column, part: Column) -> tuple[Column, Column, Column]:
        hit = F.instr(part, _SHUT) > 1
        m = F.when(hit, F.substring_index(part, _SHUT, 1)).otherwise("")
        rest = F.substring_index(part, _SEAL, -1)
        after = F.substring_index(F.substring_index(part, _SEAL, 1), _SHUT, -1)
        end = state["at"] + F.length(m)
        on = F.struct((end + F.length(rest)).cast("int").alias("at"), F.substring(F.concat(state["before"], m, rest), -BEFORE, BEFORE).alias("before"))
        return on, hit, F.struct(state["at"].alias("start"), end.alias("end"), m.alias("m"), state["before"].alias("before"), after.alias("after"))

    return F.when(text.rlike(probe), _walk(F.split(marked, _OPEN, -1), zero, step, SPAN)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    """The base check of a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int")).otherwise(999) <= 255)
    if kind == "card":
        return (n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _holds(kind, s["m"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans by kind and candidates with their features: a row per document, without its text."""
    # marks in the text itself become another control character: no pattern holds either
    text = F.translate(F.coalesce(documents[text_col].cast("string"), F.lit("")), _OPEN + _SHUT + _SEAL, "\x04\x04\x04")
    src = documents.select(documents[id_col].cast("long").alias("doc_id"), text.alias("text"))
    return _find(src, "doc_id", "text").drop("text")


def _find(src: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text")
    wide = [F.concat(*[_spans(text, *g) for g in WIDE[k]]).alias(f"wide_{k}") for k in KINDS]
    out = src.select(*keep, *[_spans(text, *BASE[k]).alias(f"raw_{k}") for k in KINDS], *wide)
    out = out.withColumns({f"base_{k}": F.filter(f"raw_{k}", _check(k)) for k in KINDS})

    def candidate(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _bits(kind, s["m"], s["before"], s["after"]).alias("bits"))

    def lessons(kind: str):
        """What a base match teaches: (held out, bits, label) of it in other dress, of a broken one and of one within a longer number or word, each also without a hint. A fifth of the strings is held out."""
        bit = {f: 1 << i for i, f in enumerate(FEATURES)}

        def make(s: Column) -> Column:
            held, holds = F.pmod(F.xxhash64(s["m"]), F.lit(5)) == 0, _holds(kind, s["m"])

            def lesson(bits: Column, label: Column) -> Column:
                both = F.array(bits, bits.bitwiseAND(F.lit(~bit["hint"])))
                return F.transform(both, lambda b: F.struct(held.alias("held"), b.alias("bits"), label.alias("label")))

            def of(m: Column) -> Column:
                own, broken = [_bits(kind, x, s["before"], s["after"]) for x in (m, _broken(kind, m))]
                within = lambda b: b.bitwiseOR(F.lit(bit["joined_before"] | bit["joined_after"]))
                true = lambda b: F.concat(lesson(b, F.lit(True)), lesson(within(b), F.lit(False)), lesson(broken, F.lit(False)))
                return _let(own, lambda b: F.when(holds, true(b)).otherwise(lesson(b, F.lit(False))))

            return _let(_dressed(kind, s["m"]), of)

        return make

    short = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return out.select(
        *keep, *[short(f"base_{k}").alias(k) for k in KINDS],
        F.concat(*[F.transform(f"wide_{k}", candidate(k)) for k in KINDS]).alias("candidates"),
        F.flatten(F.concat(*[F.transform(f"raw_{k}", lessons(k)) for k in KINDS])).alias("lessons"),
    )


def _bits(kind: str, m: Column, before: Column, after: Column) -> Column:
    """The features of a candidate in its context as bits of a number."""
    d, two = _digits(m), r"[\[\](){}]"
    has = {k: F.lit(k == kind) for k in KINDS} | {
        "hint": before.rlike(HINTS[kind]),
        "joined_before": before.rlike(r"[\p{L}\p{N}_=\"'/.-]$"),
        "joined_after": after.rlike(r"[\p{L}\p{N}_\"'/]"),
        "octets": ~m.rlike("[0-9]{4}") & F.forall(F.split(F.regexp_replace(m, "[^0-9]+", "."), r"\."), lambda p: F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255),
        "brackets": m.rlike(two),
        "spaces": m.contains(" "),
        "long": F.length(d) > 15,
        "short": F.length(d) < 9,
        "luhn": (F.length(d) > 1) & F.call_function("luhn_check", F.when(F.length(d) > 1, d).otherwise(F.lit("0"))),
        "alpha_tail": F.substring(m, -2, 2).rlike("^[A-Za-z]{2}$"),
        "known_tail": F.substring(m, -5, 5).rlike(TAILS),
        "card_length": F.length(d).between(13, 19),
    }
    return reduce(lambda a, b: a + b, [F.when(has[f], 1 << i).otherwise(0) for i, f in enumerate(FEATURES)]).cast("int")


def _dressed(kind: str, m: Column) -> Column:
    """A base match as the wide generators meet such data: one of a few forms, by its hash."""
    form = F.pmod(F.hash(m), F.lit(4))
    pick = lambda *forms: F.element_at(F.array(*[F.lit(f) for f in forms]), form + 1)
    if kind == "email":
        return F.concat(F.substring_index(m, "@", 1), pick(" at ", " [at] ", "(at)", " @ "), F.replace(F.substring_index(m, "@", -1), F.lit("."), pick(" dot ", " [dot] ", "(dot)", ".")))
    if kind == "ip":
        return F.replace(m, F.lit("."), pick("[.]", "(.)", "[dot]", " dot "))
    d = _digits(m)
    if kind == "card":
        return F.replace(F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1."), F.lit("."), pick(".", "_", "/", "  "))
    last = F.regexp_replace(F.substring(d, -10, 10), "^([0-9]{3})([0-9]{3})", pick("($1) $2-", "$1-$2-", "$1.$2.", "001 $1 $2 "))
    return F.when(_holds(kind, m), last).otherwise(d)


def _broken(kind: str, m: Column) -> Column:
    """A dressed match after a change that its kind doesn't bear: a name that ends in a digit or a word, a part beyond 255, a wrong check digit, too few digits."""
    if kind == "email":
        return F.concat(m, F.when(F.pmod(F.hash(m), F.lit(2)) == 0, "7").otherwise("ing"))
    if kind == "ip":
        return F.concat(F.lit("9"), F.regexp_replace(m, "^[0-9]{1,3}", "99"))
    if kind == "card":
        return F.concat(F.regexp_replace(m, "[0-9]$", ""), F.pmod(F.substring(m, -1, 1).cast("int") + 1, F.lit(10)).cast("string"))
    return F.substring(m, -8, 8)


def fit(cells: list[tuple[int, int, int]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Logistic gradient boosting on (feature bits, positives, negatives): a list of trees.

    A tree is a leaf value, or (feature number, tree if unset, tree if set).
    The cells are all the data there is to a boolean feature vector, so the fit
    covers every candidate and its size doesn't depend on the corpus.
    """
    score = [0.0] * len(cells)
    trees = []

    def leaf(g: float, h: float) -> float:
        return rate * g / (h + 1.0)

    def grow(at: list[int], grad: list[float], hess: list[float], d: int):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        best = (1e-6, None)
        if d:
            for f in range(len(FEATURES)):
                g1 = sum(grad[i] for i in at if cells[i][0] >> f & 1)
                h1 = sum(hess[i] for i in at if cells[i][0] >> f & 1)
                gain = g1 * g1 / (h1 + 1) + (g - g1) ** 2 / (h - h1 + 1) - g * g / (h + 1)
                best = max(best, (gain, f), key=lambda x: x[0])
        if best[1] is None:
            return leaf(g, h)
        f = best[1]
        return (f, grow([i for i in at if not cells[i][0] >> f & 1], grad, hess, d - 1), grow([i for i in at if cells[i][0] >> f & 1], grad, hess, d - 1))

    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [y - (y + n) * q for (_, y, n), q in zip(cells, p, strict=True)]
        hess = [(y + n) * q * (1 - q) for (_, y, n), q in zip(cells, p, strict=True)]
        tree = grow(list(range(len(cells))), grad, hess, depth)
        trees.append(tree)
        score = [s + value(tree, c[0]) for s, c in zip(score, cells, strict=True)]
    return trees


def value(tree, bits: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bits >> tree[0] & 1 else tree[1]
    return tree


def thresholds(trees: list, held_out: list[tuple[int, int, int]], precision: float = PRECISION) -> dict[str, float]:
    """For each kind the score from which held-out candidates reach the precision: midway between the last that does and the next lower one, or even odds; infinite where none do."""
    out = {}
    for i, kind in enumerate(KINDS):
        own = sorted(((sum(value(t, b) for t in trees), y, n) for b, y, n in held_out if b >> i & 1), reverse=True)
        out[kind], good, all_ = math.inf, 0, 0
        for k, (s, y, n) in enumerate(own):
            good, all_ = good + y, all_ + y + n
            if (k + 1 == len(own) or own[k + 1][0] < s) and good >= precision * all_ and s > 0:
                out[kind] = (s + max(0.0, own[k + 1][0] if k + 1 < len(own) else 0.0)) / 2
    return out


def _tree_sql(tree, bits: str) -> str:
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    return f"CASE WHEN {bits} & {1 << tree[0]} = 0 THEN {_tree_sql(tree[1], bits)} ELSE {_tree_sql(tree[2], bits)} END"


class Model:
    """Boosted trees and thresholds as one SQL condition."""

    def __init__(self, trees: list, limits: dict[str, float]):
        self.trees, self.limits = trees, limits

    def margin(self) -> str:
        """How far a candidate ``c`` is above its kind's threshold; null where the kind has none."""
        score = " + ".join(f"({_tree_sql(t, 'c.bits')})" for t in self.trees) or "0D"
        limit = " ".join(f"WHEN c.kind = '{k}' THEN {v!r}D" for k, v in self.limits.items() if v < math.inf)
        return f"{score} - CASE {limit} END" if limit else "CAST(NULL AS DOUBLE)"


def train(found: DataFrame) -> Model:
    """Fit on the lessons of all base matches, and set each kind's threshold on those of held-out strings.

    What reaches the driver is a row per distinct feature vector (2^17 at most).
    Without lessons the model takes nothing.
    """
    c = found.select(F.explode("lessons").alias("c"))
    cells = c.groupBy("c.held", "c.bits").agg(F.sum(F.col("c.label").cast("int")).alias("y"), F.sum(1 - F.col("c.label").cast("int")).alias("n")).collect()
    part = lambda held: sorted((r["bits"], r["y"], r["n"]) for r in cells if r["held"] == held)
    trees = fit(part(False))
    return Model(trees, thresholds(trees, part(True)))


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Add ``spans``: per kind the base spans and the candidates that the model selects.

    A candidate must pass its kind's threshold and touch no base span. Of those
    that overlap, the walk from left to right keeps the one further above its
    threshold, then the longer one, then the first.
    """
    item = lambda s, kind, margin, added: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["end"].alias("end"), kind.alias("kind"), margin.alias("margin"))
    kind_of = "struct<start:int,added:int,end:int,kind:string,margin:double>"
    passed = F.expr(f"filter(transform(candidates, c -> struct(c.start, c.end, c.kind, {model.margin()} AS margin)), c -> c.margin >= 0)")
    own_of = lambda kind: F.transform(kind, lambda s: item(s, F.lit(kind), F.lit(None).cast("double"), 0))
    base = F.concat(*[own_of(k) for k in KINDS])

    def after_base(reach: Column, x: Column) -> tuple[Column, Column, Column]:
        own = x["added"] == 0
        return F.when(own, F.greatest(reach, x["end"])).otherwise(reach), own | (x["start"] >= reach), x

    def before_base(next_: Column, x: Column) -> tuple[Column, Column, Column]:
        own = x["added"] == 0
        return F.when(own, F.least(next_, x["start"])).otherwise(next_), ~own & (x["end"] <= next_), x

    def better(best: Column, x: Column) -> tuple[Column, Column, Column]:
        apart = x["start"] >= best["end"]
        wins = (x["margin"] > best["margin"]) | ((x["margin"] == best["margin"]) & (x["end"] - x["start"] > best["end"] - best["start"]))
        return F.when(apart | wins, x).otherwise(best), apart & (best["end"] >= 0), best

    def selected(passed: Column) -> Column:
        both = F.array_sort(F.concat(base, F.transform(passed, lambda c: item(c, c["kind"], c["margin"], 1))))
        free = F.reverse(_walk(F.reverse(_walk(both, F.lit(0), after_base, kind_of)), F.lit(_END), before_base, kind_of))
        short = F.concat(F.transform(free, _taken), F.array(_edge(_END)))
        return F.when(F.size(passed) > 0, _walk(short, _edge(-1), better, TAKEN)).otherwise(F.array().cast(f"array<{TAKEN}>"))

    plain = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))
    added = lambda kind: F.transform(F.filter("_added", lambda c: c["kind"] == kind), plain)
    spans = F.concat(*[F.transform(F.array_sort(F.concat(k, added(k))), _named(k)) for k in KINDS])
    return found.withColumn("_added", _let(passed, selected)).withColumn("spans", spans).drop("_added")


_END = 2147483647


def _taken(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["margin"].alias("margin"))


def _edge(at: int) -> Column:
    """An empty span before or behind all others."""
    return F.struct(F.lit(at).alias("start"), F.lit(at).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("margin"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of each row's whole text.

    Base spans are always kept; the model adds others of the same kinds where
    they touch none. The text is read once, the spans found in it are
    checkpointed, the model is fitted on all of them, and a second, textless
    pass applies it. A null text counts as empty; an empty text has no spans;
    repeated rows give a row each; an empty table gives no rows (and a model
    that takes nothing); other columns are ignored. Very long texts are searched
    whole; the work grows with the text, and with its spans to the power 1.5.
    """
    found = cut(find(documents, id_col, text_col))
    out = with_spans(found, train(found))
    base = F.concat(*[F.transform(k, _named(k)) for k in KINDS])
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets, all other columns kept.

    Overlapping spans are replaced as one, by the kind of the first. The model
    is fitted on these documents; they are stored once with their spans, which
    are found once. A null text stays null, an empty one empty; repeated rows
    give a row each; an empty table gives none; other columns may have any name.
    """
    names = documents.columns
    text = F.translate(F.coalesce(documents[text_col].cast("string"), F.lit("")), _OPEN + _SHUT + _SEAL, "\x04\x04\x04")
    src = documents.select(F.struct(*[documents[c] for c in names]).alias("_row"), text.alias("text"))
    found = stored(_find(src, "_row", "text").drop("text"))
    found = with_spans(found, train(found))
    original = F.col("_row")[text_col].cast("string")

    def merge(open_: Column, x: Column) -> tuple[Column, Column, Column]:
        apart = x["start"] >= open_["end"]
        grown = F.struct(open_["start"].alias("start"), F.greatest(open_["end"], x["end"]).alias("end"), open_["kind"].alias("kind"), open_["margin"].alias("margin"))
        return F.when(apart, x).otherwise(grown), apart & (open_["end"] >= 0), open_

    def pieces(all_: Column) -> Column:
        """The texts before each span with the span's kind; a block's part of the text is cut out once."""

        def block(at: Column, size: Column) -> Column:
            first = F.when(at == 0, 0).otherwise(F.get(all_, at - 1)["end"])
            last = F.get(all_, F.least(at + size, F.size(all_)) - 1)["end"]
            own = F.struct(F.slice(all_, at + 1, size).alias("spans"), first.alias("first"), F.substring(original, first + 1, last - first).alias("text"))

            def one(b: Column, s: Column, i: Column) -> Column:
                from_ = F.when(i == 0, b["first"]).otherwise(F.get(b["spans"], i - 1)["end"])
                return F.concat(F.substring(b["text"], from_ - b["first"] + 1, s["start"] - from_), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            return _let(own, lambda b: F.transform(b["spans"], lambda s, i: one(b, s, i)))

        behind = F.substring(original, F.get(all_, F.size(all_) - 1)["end"] + 1, F.lit(_END))
        return F.concat(F.array_join(F.flatten(_blocks(all_, block)), ""), behind)

    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).alias("margin"))))
    clean = _let(_walk(F.concat(by_place, F.array(_edge(_END))), _edge(-1), merge, TAKEN), pieces)
    new = F.when(F.size("spans") > 0, clean).otherwise(original)
    return found.select(*[new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """The whole table of documents; cases as in ``personal_data``."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
