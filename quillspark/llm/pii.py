r"""PII by candidate gradient boosting, with DataFrame functions only.

Base rules (email, ip, card, phone) are exact patterns with checks.  High-recall generators propose
further, overlapping candidates: runs of digits with separators, written-out mail addresses, and numbers
grouped like a card or phone wherever they lie, so that those beside another number are proposed alone.  Boosted
trees score a candidate from its format and context; a threshold for each generator, calibrated on held-out
examples to a precision of at least ``PRECISION``, selects the spans that are added.

The trees are trained on labelled sentences that a seeded rule makes (``examples``), with features computed by
the same DataFrame expressions as in the scan, and are applied as nested conditions inside the query:
the scan is one map-only pass.  Patterns are possessive, so no text makes them backtrack or recurse.

Spans of all matches come from two built-ins that see the same matches: the pieces between matches
(``split``) and the matches (``regexp_extract_all``); starts are prefix sums of their lengths, in chunks.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
EXAMPLES = 4000
TREES, DEPTH, RATE = 60, 3, 0.3

# Fixed patterns of the base rules, written possessively; they find the same leftmost matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\\+[0-9][ ().0-9-]+[0-9]"
# High-recall generators.
NUMBER = r"(?<![0-9A-Za-z])\\(?[0-9](?:[ ()./-]{0,2}[0-9])++(?![A-Za-z])"
MAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\\[at\\]|\\(at\\)|\\bat\\b) ?"
    r"[A-Za-z0-9-]++ ?(?:\\[dot\\]|\\(dot\\)|\\bdot\\b) ?[A-Za-z]{2,}+"
)
GROUPED = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4})(?![0-9])"
    r"|(?<![0-9+])\\+?(?:[0-9]{1,3}[ .-]?)?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)

FEATURES = {
    "mail": "if(g = 1, 1, 0)",
    "grouped": "if(g = 2, 1, 0)",
    "digits": "length(regexp_replace(m, '[^0-9]', ''))",
    "length": "length(m)",
    "groups": "size(split(m, '[^0-9]+'))",
    "longest": "array_max(transform(split(m, '[^0-9]+'), x -> length(x)))",
    "last": "length(regexp_extract(m, '[0-9]*$', 0))",
    "first": "length(regexp_extract(m, '^[^0-9]?([0-9]*)', 1))",
    "parens": "if(contains(m, '('), 1, 0)",
    "brackets": "if(contains(m, '['), 1, 0)",
    "domain": "if(m rlike '[^A-Za-z](com|org|net|edu|gov|info|io|de|fr|es|uk)$', 1, 0)",
    "dashes": "length(m) - length(replace(m, '-', ''))",
    "dots": "length(m) - length(replace(m, '.', ''))",
    "spaces": "length(m) - length(replace(m, ' ', ''))",
    "slashes": "length(m) - length(replace(m, '/', ''))",
    "luhn": "if(length(regexp_replace(m, '[^0-9]', '')) between 13 and 19, if(luhn_check(regexp_replace(m, '[^0-9]', '')), 1, 0), 0)",
    "plus": "if(lc rlike '[+]$', 1, 0)",
    "asks": "if(lower(lc) rlike '(phone|tel|call|mobile|cell|fax|ssn|social|card|account|iban|passport|mail|contact|reach)[^a-z]*[a-z]{0,6}[^a-z]*$', 1, 0)",
    "plain": "if(lower(lc) rlike '(version|page|chapter|isbn|order|invoice|item|no|number|year|since|in|section|figure|v|build|code|ref)[^a-z0-9]*$', 1, 0)",
    "money": "if(lc rlike '[$€£%#=_/]$' or rc rlike '^[%$€£_=/#]', 1, 0)",
}
_SPANS = "array<struct<kind: string, s: bigint, e: bigint, m: string, lc: string, rc: string>>"
_NONE = f"cast(array() as {_SPANS})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefix(lens: str) -> str:
    """Sums of all earlier elements, in chunks of 256 so that building the array stays linear."""
    chunks = f"transform(sequence(0, (size({lens}) - 1) div 256), c -> slice({lens}, c * 256 + 1, 256))"
    sums = "aggregate(transform(chunks, c -> aggregate(c, 0L, (a, x) -> a + x)), array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    inner = "slice(aggregate(c, array(heads[k]), (a, x) -> concat(a, array(element_at(a, -1) + x))), 1, size(c))"
    return _let("chunks", chunks, _let("heads", sums, f"flatten(transform(chunks, (c, k) -> {inner}))"))


_LEAST = "-4611686018427387904L"
CHUNK = 1024  # code points of a chunk of text


def _running_max(values: str) -> str:
    """The largest element up to each position, in chunks like ``_prefix``."""
    chunks = f"transform(sequence(0, (size({values}) - 1) div 256), c -> slice({values}, c * 256 + 1, 256))"
    step = "(a, x) -> concat(a, array(greatest(element_at(a, -1), x)))"
    heads = f"aggregate(transform(chunks, c -> array_max(c)), array({_LEAST}), {step})"
    inner = f"slice(aggregate(c, array(heads[k]), {step}), 2, size(c))"
    return _let("chunks", chunks, _let("heads", heads, f"flatten(transform(chunks, (c, k) -> {inner}))"))


def _apart(candidates: str, base: str) -> str:
    """Candidates (s, e, m) in order that overlap no base span: one sweep over both in order of their starts.

    A candidate lies apart if no base span that starts before it ends within it and none starts within it.
    """
    both = f"""sort_array(concat(transform({base}, b -> struct(b.s as s, 0 as k, b.e as e, '' as m)),
      transform({candidates}, c -> struct(c.s as s, 1 as k, c.e as e, c.m as m))))"""
    ends = f"transform(both, x -> if(x.k = 0, x.e, {_LEAST}))"
    starts = f"transform(reverse(both), x -> if(x.k = 0, -x.s, {_LEAST}))"
    kept = "filter(both, (x, i) -> x.k = 1 and before[i] <= x.s and -after[size(both) - 1 - i] >= x.e)"
    found = _let("before", _let("ends", ends, _running_max("ends")), _let("after", _let("begins", starts, _running_max("begins")), kept))
    return f"transform({_let('both', both, found)}, x -> struct(x.s as s, x.e as e, x.m as m))"


def _merged(spans: str) -> str:
    """Unions of overlapping spans in order, each with the kind of its first span."""
    ordered = f"sort_array(transform({spans}, x -> struct(x.s as s, -x.e as e, x.kind as kind)))"
    firsts = "filter(sequence(0, size(sp) - 1), i -> i = 0 or sp[i].s >= reach[i - 1])"
    groups = "transform(at, (i, k) -> struct(sp[i].s as s, reach[coalesce(get(at, k + 1), size(sp)) - 1] as e, sp[i].kind as kind))"
    reach = _let("ends", "transform(sp, x -> -x.e)", _running_max("ends"))
    return _let("sp", ordered, _let("reach", reach, _let("at", firsts, groups)))


def _between(low: str, high: str) -> str:
    """The text from one code point to another, out of chunks, so that no text is walked again for each span."""
    first, last = f"int({low} div {CHUNK})", f"int({high} div {CHUNK})"
    head = f"substring(coalesce(get(cut, {first}), ''), int({low} % {CHUNK}) + 1)"
    tail = f"left(coalesce(get(cut, {last}), ''), int({high} % {CHUNK}))"
    within = f"substring(coalesce(get(cut, {first}), ''), int({low} % {CHUNK}) + 1, int({high} - {low}))"
    return f"if({first} = {last}, {within}, concat({head}, array_join(slice(cut, {first} + 2, {last} - {first} - 1), ''), {tail}))"


def _matches(kind: str, pattern: str, guard: str) -> str:
    """Spans of all matches in t, each with a little of the text before and after it."""
    steps = "transform(ms, (x, i) -> cast(length(pieces[i]) + length(x) as bigint))"
    spans = f"""transform(ms, (x, i) -> struct('{kind}' as kind, starts[i] + length(pieces[i]) as s,
      starts[i] + length(pieces[i]) + length(x) as e, x as m, right(pieces[i], 24) as lc, left(pieces[i + 1], 8) as rc))"""
    body = f"if(size(ms) = 0, {_NONE}, {_let('starts', _let('steps', steps, _prefix('steps')), spans)})"
    found = _let("ms", f"regexp_extract_all(t, '{pattern}', 0)", _let("pieces", f"split(t, '{pattern}', -1)", body))
    return f"if({guard}, {found}, {_NONE})"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_BASE = {
    "email": (EMAIL, "contains(t, '@')", "true"),
    "ip": (IP, "digit and contains(t, '.')", r"forall(split(x.m, '\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"),
    "card": (CARD, "digit", f"length({_DIGITS}) between 16 and 19 and luhn_check({_DIGITS})"),
    "phone": (PHONE, "digit and contains(t, '+')", f"length({_DIGITS}) between 8 and 15"),
}


def _proposed(df: DataFrame) -> DataFrame:
    """Adds candidates (array of spans with a generator number g and features) to a table with text t and flag digit."""
    number = _matches("0", NUMBER, "digit")
    mail = _matches("1", MAIL, "contains(t, 'dot')")
    grouped = _matches("2", GROUPED, "digit")
    feature = ", ".join(f"cast({e} as double) as {n}" for n, e in FEATURES.items())
    inner = feature
    for name in ("m", "lc", "rc"):
        inner = _in(inner, name, f"x.{name}")
    inner = _in(inner, "g", "cast(x.kind as int)")
    return df.withColumn("proposed", F.expr(f"transform(concat({number}, {mail}, {grouped}), x -> struct(cast(x.kind as int) as g, x.s as s, x.e as e, x.m as m, {inner}))"))


def _in(expression: str, name: str, value: str) -> str:
    return re.sub(rf"(?<![\w.'\[]){name}(?![\w'(])", value, expression)


def _text(docs: DataFrame, *keep: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, t.alias("t")).withColumn("digit", F.expr("t rlike '[0-9]'"))


def examples(n: int = EXAMPLES, seed: int = 10) -> list[tuple[str, list[str], int]]:
    """(sentence, values, label) from a seeded rule: one value of a known kind, or a private one beside another number.

    With label 1 the values are the sentence's personal data; with label 0 it has none.
    """
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    lead = lambda k: rnd.choice("23456789") + digits(k - 1)
    word = lambda: "".join(rnd.choice("abcdefghinorstu") for _ in range(rnd.randint(2, 9)))
    year = lambda: str(rnd.randint(1890, 2035))

    def card() -> str:
        body = rnd.choice("3456") + digits(14)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(body))
        full, sep = body + str(-total % 10), rnd.choice(["", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    private = [
        lambda: f"{lead(3)}-{lead(3)}-{digits(4)}",
        lambda: f"({lead(3)}) {lead(3)}-{digits(4)}",
        lambda: f"{lead(3)}.{lead(3)}.{digits(4)}",
        lambda: f"0{lead(2)} {lead(3)} {digits(4)}",
        lambda: f"00{lead(2)} {lead(3)} {digits(3)} {digits(4)}",
        lambda: f"{lead(3)}-{digits(2)}-{digits(4)}",
        card,
        lambda: f"+{digits(1)} ({lead(3)}) {lead(3)}-{digits(4)}",
        lambda: f"{word()}{rnd.choice(['', '.' + word()])} {rnd.choice(['[at]', '(at)', 'at'])} {word()} {rnd.choice(['[dot]', '(dot)', 'dot'])} {rnd.choice(['com', 'org', 'net'])}",
    ]
    plain = [
        lambda: f"{year()}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}/{digits(2)}/{year()}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(1)}",
        lambda: f"{year()}",
        lambda: f"{year()}-{year()}",
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{digits(rnd.randint(2, 12))}",
        lambda: f"{digits(rnd.randint(13, 30))}",
        lambda: f"{digits(2)} {digits(2)} {digits(2)}",
        lambda: f"{digits(4)} {digits(4)}",
        lambda: f"{lead(rnd.randint(1, 3))} " + " ".join(digits(3) for _ in range(rnd.randint(1, 4))),
        lambda: f"{digits(1)}.{digits(rnd.randint(3, 18))}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(3)}",
        lambda: f"{digits(2)}.{digits(1)}.{digits(3)}.{digits(2)}",
        lambda: f"{word()} at {word()} dot {word()}",
    ]
    asks, says = ["Phone: ", "call me at ", "my card ", "tel ", "contact ", "SSN ", "mobile "], ["version ", "page ", "ISBN ", "order ", "since ", "$", "item no ", "in "]
    out = []
    for i in range(n):
        positive = i % 2 == 0
        value = rnd.choice(private if positive else plain)()
        before = rnd.choice(asks) if rnd.random() < (0.4 if positive else 0.05) else rnd.choice(says) if rnd.random() < (0.0 if positive else 0.4) else ""
        values = [value]
        if positive and rnd.random() < 0.25:
            other = rnd.choice(private[:-1])() if rnd.random() < 0.5 else ".".join(str(rnd.randint(0, 255)) for _ in range(4))
            values = [value, other] if rnd.random() < 0.5 else [other, value]
        shown = f"{word()} {word()} {before}{' '.join(values)} {word()} {word()}"
        out.append((shown, values + [v[1:] for v in values if v[0] == "+"], int(positive)))
    return out


class Boosted:
    """Gradient boosted regression trees on the log loss, of depth three."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> None:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list = []
        self.cuts = [np.unique(np.quantile(col, np.linspace(0.02, 0.98, 25))) for col in x.T]
        raw = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH, rate)
            self.trees.append(tree)
            raw = raw + self._apply(tree, x)

    def _grow(self, x, grad, hess, rows, depth, rate):
        value = rate * grad[rows].sum() / (hess[rows].sum() + 1.0)
        if not depth or len(rows) < 40:
            return float(value)
        base = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        best = (1e-6, None, None)
        for f, cuts in enumerate(self.cuts):
            col = x[rows, f]
            for cut in cuts:
                left = col <= cut
                if 20 <= left.sum() <= len(rows) - 20:
                    gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                    gr, hr = grad[rows].sum() - gl, hess[rows].sum() - hl
                    gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - base
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        _, f, cut = best
        if f is None:
            return float(value)
        left = x[rows, f] <= cut
        return (f, cut, self._grow(x, grad, hess, rows[left], depth - 1, rate), self._grow(x, grad, hess, rows[~left], depth - 1, rate))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)

    def sql(self, row: str, names: list[str]) -> str:
        def node(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            f, cut, low, high = tree
            return f"if({row}.{names[f]} <= {cut!r}D, {node(low)}, {node(high)})"

        return " + ".join([f"{self.start!r}D", *map(node, self.trees)])


class Model:
    def __init__(self, trees: Boosted, thresholds: tuple[float, ...], held_out: tuple[float, float]) -> None:
        self.trees, self.thresholds, self.held_out = trees, thresholds, held_out


def train(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> Model:
    """Trees and thresholds from the made sentences: a bounded set of ``n``; a fifth of it is held out."""
    rows = [(i, s, v, y) for i, (s, v, y) in enumerate(examples(n))]
    df = spark.createDataFrame(rows, "i int, text string, vs array<string>, y int")
    made = _proposed(_text(df, "i", "vs", "y")).select("i", "vs", "y", F.explode("proposed").alias("c"))
    names = list(FEATURES)
    got = made.select("i", F.expr("if(array_contains(vs, c.m), y, 0)").alias("y"), "c.g", *[f"c.{f}" for f in names]).orderBy("i", "c.s", "c.e", "c.g").collect()
    data = np.array([[r[f] for f in ("i", "y", "g", *names)] for r in got], float)
    held = data[:, 0] % 5 == 0
    trees = Boosted(data[~held, 3:], data[~held, 1])
    raw, y, g = trees.raw(data[held, 3:]), data[held, 1], data[held, 2]
    thresholds = []
    for kind in range(3):
        order = np.argsort(-raw[g == kind])
        hits = np.cumsum(y[g == kind][order]) / (np.arange(len(order)) + 1)
        # a threshold takes all that score alike
        last = np.diff(raw[g == kind][order], append=-np.inf) < 0
        good = np.flatnonzero((hits >= precision) & last)
        thresholds.append(float(raw[g == kind][order][good[-1]]) if len(good) else float("1e9"))
    chosen = raw >= np.array(thresholds)[g.astype(int)]
    return Model(trees, tuple(thresholds), (float(y[chosen].mean()), float(chosen[y == 1].mean())))


_MODEL: list[Model] = []


def model_for(spark: SparkSession) -> Model:
    """The model is the same in every session, so a process trains it once."""
    if not _MODEL:
        _MODEL.append(train(spark))
    return _MODEL[0]


def scan(docs: DataFrame, model: Model | None = None, *keep: str) -> DataFrame:
    """The columns ``keep`` (doc_id), t (text), base (spans by kind, then start) and learned (further spans).

    A span has kind, s, e (code points, end exclusive) and m (its text).  Null text counts as empty.
    Repeated rows and null ids are returned as they come; an empty table gives an empty result.
    """
    model = model or model_for(docs.sparkSession)
    keep = keep or ("doc_id",)
    df = _text(docs, *keep)
    for kind, (pattern, guard, check) in _BASE.items():
        df = df.withColumn(f"_{kind}", F.expr(f"filter({_matches(kind, pattern, guard)}, x -> {check})"))
    df = df.withColumn("base", F.expr("transform(concat(" + ", ".join(f"_{k}" for k in KINDS) + "), x -> struct(x.kind as kind, x.s as s, x.e as e, x.m as m))"))
    df = _proposed(df)
    raw = model.trees.sql("c", list(FEATURES))
    threshold = f"array({', '.join(f'{t!r}D' for t in model.thresholds)})[c.g]"
    good = f"transform(filter(proposed, c -> {raw} >= {threshold}), c -> struct(c.s as s, c.e as e, c.m as m))"
    # a span that two generators propose counts once
    once = "filter(spans, (x, i) -> i = 0 or x.s <> spans[i - 1].s or x.e <> spans[i - 1].e)"
    chosen = f"transform({once}, c -> struct('learned' as kind, c.s as s, c.e as e, c.m as m))"
    none = "cast(array() as array<struct<kind: string, s: bigint, e: bigint, m: string>>)"
    learned = _let("good", good, f"if(size(good) = 0, {none}, {_let('spans', _apart('good', 'base'), chosen)})")
    return df.withColumn("learned", F.expr(learned)).select(*keep, "t", "base", "learned", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The contract's columns of ``scan``."""
    found = scan(docs, model)
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("concat(base, learned)")).alias("spans"),
    )


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each span, or union of overlapping spans, of the text replaced by the first one's kind, as in [EMAIL].

    Texts with no span, null texts and all other columns, whatever their names, are kept as they are.
    """
    inner = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), "text")
    found = scan(inner, model, "row")
    gap = _between("if(i = 0, 0L, p[i - 1].e)", "x.s")
    parts = f"transform(p, (x, i) -> concat({gap}, '[', upper(x.kind), ']'))"
    rest = _between("element_at(p, -1).e", "length(t)")
    text = f"concat(array_join({parts}, ''), {rest})"
    cut = f"regexp_extract_all(t, '(?s).{{1,{CHUNK}}}', 0)"
    clean = F.expr(f"if(size(base) + size(learned) = 0, row.text, {_let('p', _merged('concat(base, learned)'), _let('cut', cut, text))})")
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
