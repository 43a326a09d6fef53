"""Secret scans with format grammars inferred from labelled credentials.

1. A pass over the whole texts finds the base spans and high-recall candidates: runs of credential characters, at
   least 12 long, that mix letters and digits or cases, also those that reach beyond a base span they overlap.
2. Base values, labelled by their kind, train one probabilistic automaton for each kind: the prefix tree
   of the values is reduced by merging states whose outgoing frequencies are compatible under
   Hoeffding's bound (red-blue order, merges folded to keep the automaton deterministic).
3. The background is what non-secrets look like: names, dates and numbers that a seeded rule makes, and the
   candidates that overlap no base span, without those that resemble a labelled format against the made ones,
   so that unlabelled secrets do not teach it.
4. A second pass scores every candidate by its log-likelihood a character under a format, less that under the
   background.  Each format has its own limit, set on labelled values and non-secrets that nothing was fitted
   on: no such non-secret passes, and nineteen of twenty such values do where the two can be told apart.

Training takes at most ``SAMPLE`` distinct values a kind, those with the smallest hash among all of at most ``LONGEST``
characters; each task of the first pass sends no more than that.  Finding and scoring cover every text and candidate of
any length.  No value is written to storage: the texts are read twice instead.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, narrow, slices, small_batches

# Fixed patterns of the base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this is every run of 16 or more
KINDS = ("assign", "access", "hex", "learned")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SAMPLE = 300
LONGEST = 256
ALPHA = 0.05
MADE = 1000  # non-secrets made by rule
END = "$"
# classes of characters with their sizes; an automaton reads classes and spreads its mass evenly within one
CLASSES = {"9": 10, "f": 6, "z": 20, "F": 6, "Z": 20, "+": 1, "/": 1, "_": 1, "=": 1, "-": 1, ".": 1, "?": 64}


def class_of(c: str) -> str:
    if c.isascii():
        if c.isdigit():
            return "9"
        if c.isalpha():
            return {True: "f", False: "z"}[c in "abcdef"] if c.islower() else {True: "F", False: "Z"}[c in "ABCDEF"]
        if c in "+/_=-.":
            return c
    return "?"


class Automaton:
    """A probabilistic deterministic automaton inferred by compatible state merging."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for value in values:
            state = 0
            for c in map(class_of, value):
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                state = self.next[state][c]
            self.count[state][END] += 1
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))
        self.red = self._merge()

    def _total(self, s: int) -> int:
        return sum(self.count[s].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Recursively, all outgoing frequencies differ by less than Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = self.spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below blue ``b`` to red ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> list[int]:
        red = [0]
        while True:
            known = set(red)
            blue = sorted(((-self._total(t), r, c, t) for r in red for c, t in self.next[r].items() if t not in known))
            if not blue:
                return red
            _, r, c, t = blue[0]
            for to in red:
                if self._compatible(to, t):
                    self.next[r][c] = to
                    self._fold(to, t)
                    break
            else:
                red.append(t)

    def per_character(self, value: str) -> float:
        """Mean log-likelihood a character, the end included; unseen steps have a small smoothed mass."""
        state, total = 0, 0.0
        kinds = len(CLASSES) + 1
        for c in [*map(class_of, value), END]:
            counts = self.count[state] if state is not None else {}
            p = (counts.get(c, 0) + 0.1) / (sum(counts.values()) + 0.1 * kinds)
            total += math.log(p) - (math.log(CLASSES[c]) if c != END else 0.0)
            state = self.next[state].get(c) if state is not None else None
        return total / (len(value) + 1)


class Pairs:
    """Frequencies of neighbouring classes: a background for values whose steps no automaton has seen."""

    def __init__(self, values: list[str]) -> None:
        self.count: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for value in values:
            steps = [END, *map(class_of, value), END]
            for a, b in zip(steps, steps[1:]):
                self.count[a][b] += 1
        self.count = {a: dict(n) for a, n in self.count.items()}
        self.total = {a: sum(n.values()) for a, n in self.count.items()}

    def per_character(self, value: str) -> float:
        total, last, kinds = 0.0, END, len(CLASSES) + 1
        for c in [*map(class_of, value), END]:
            total += math.log((self.count.get(last, {}).get(c, 0) + 0.1) / (self.total.get(last, 0) + 0.1 * kinds))
            total -= math.log(CLASSES[c]) if c != END else 0.0
            last = c
        return total / (len(value) + 1)


_NAMES = """about account address after archive article author average backup before between branch build business
chapter client code company config content count country data default design detail device digest document down
driver early edition email engine error event example export family figure file filter final first folder format
garden general group guide handler header history house image import index info input island item january journal
kitchen language large layout letter level library limit line list local main manager market master member message
method model module month mountain music name nature network notes number object office option order output owner
package page parser part people person picture place plan point post president price product profile project public
query question reader record region release report request result river sample school score season second section
select server service session setting size source start state station status store stream street string student
style summer system table target task teacher template test text theory thread title total train tree update upload
user value version video view village volume water week window winter world writer year""".split()


def made_non_secrets(n: int = MADE) -> list[str]:
    """Names with numbers, dates, versions, paths and sizes, such as texts hold; the same ones every time."""
    rnd = random.Random(20240301)
    name, number = lambda: rnd.choice(_NAMES), lambda: str(rnd.randrange(10 ** rnd.randint(1, 4)))
    two = lambda most: f"{rnd.randint(1, most):02d}"

    def one() -> str:
        words = [name() for _ in range(rnd.randint(1, 5))]
        words.insert(rnd.randint(1, len(words)), number())
        date = [str(rnd.randint(1970, 2030)), two(12), two(28)]
        case = rnd.choice([str, str, str.title, str.upper])
        form = rnd.randrange(10)
        if form < 4:
            return rnd.choice(["_", "-", "/", "="]).join(map(case, words))
        if form == 4:
            return words[0] + "".join(w.title() for w in words[1:])
        if form == 5:
            return "".join(words) if rnd.random() < 0.5 else "".join(w.title() if rnd.random() < 0.8 else w.upper() for w in words)
        if form == 6:
            return rnd.choice(["-", "_", "/"]).join([*date, *words[:2]] if rnd.random() < 0.5 else [*words[:2], *date])
        if form == 7:
            return f"{'-'.join(date)}T{two(23)}{rnd.choice(['', '-'])}{two(59)}{rnd.choice(['', 'Z', '+0100'])}"
        if form == 8:
            return f"{case(name())}{rnd.choice('-_')}v{number()}{rnd.choice('-_')}{number()}{rnd.choice(['', '-beta', '_rc1', '-final2'])}"
        return f"{name()}={number()}/{name()}={number()}" if rnd.random() < 0.5 else f"{case(name())[:3]}_{''.join(date)}_{two(23)}{two(59)}{two(59)}"

    out: set[str] = set()
    while len(out) < n:
        if len(value := one()) >= 12:
            out.add(value)
    return sorted(out, key=lambda v: hashlib.md5(v.encode()).digest())


def _parted(values: list[str]) -> tuple[list[str], list[str]]:
    """Four fifths to fit on, at least one, and the rest to set limits on."""
    values = sorted(set(values), key=lambda v: hashlib.md5(v.encode()).digest())
    at = max(1, 4 * len(values) // 5)
    return values[:at], values[at:]


class Formats:
    """An automaton and a limit for each labelled kind, and the background."""

    threshold = 0.0  # `score` is what lies above a format's own limit

    def __init__(self, labelled: dict[str, list[str]], background: list[str]) -> None:
        self.formats, held = {}, {}
        for kind, values in sorted(labelled.items()):
            train, held[kind] = _parted(values)
            # without values to set a limit on nothing can be selected
            if held[kind]:
                self.formats[kind] = Automaton(train)
        fit, rest = _parted(made_non_secrets())
        self.background = [Automaton(fit), Pairs(fit)]
        self._limit(held, rest)
        # what resembles a format, if not enough to be selected, may be a secret and must not teach the background
        clean, more = _parted([v for v in background if not any(self._above(k, v) > least for k, least in self.doubt.items())])
        if clean:
            self.background += [Automaton(clean), Pairs(clean)]
            self._limit(held, rest + more)

    def _limit(self, held: dict[str, list[str]], others: list[str]) -> None:
        self.limits, self.doubt = {}, {}
        for kind in self.formats:
            scores = sorted(self._above(kind, v) for v in held[kind])
            most = max(self._above(kind, v) for v in others)
            least = scores[len(scores) // 20]
            # midway if nineteen of twenty labelled values lie above all non-secrets, else above the latter
            self.limits[kind] = (least + most) / 2 if least > most else math.nextafter(most, math.inf)
            self.doubt[kind] = min(least, most)

    def _above(self, kind: str, value: str) -> float:
        return self.formats[kind].per_character(value) - max(b.per_character(value) for b in self.background)

    def score(self, value: str) -> float:
        """Nats a character above the background, less the limit of the format for which that is most."""
        if not self.formats:
            return -math.inf
        plain = max(b.per_character(value) for b in self.background)
        return max(a.per_character(value) - plain - self.limits[k] for k, a in self.formats.items())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by kind, then start; offsets are code points, ends exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]


_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of candidates that overlap no taken span; the taken ones are joined first, so each takes one search."""
    if not _DIGIT.search(text):
        return []
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e, _ in sorted(taken, key=lambda x: x[1]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        before = bisect.bisect_left(starts, e)
        return not before or ends[before - 1] <= s

    return [
        (*m.span(), m[0])
        for m in CANDIDATE.finditer(text)
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and free(*m.span())
    ]


MIXED = re.compile("[a-z][A-Z]|[A-Z]{2}[a-z]")


def further(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates beside those of ``candidates``: runs of letters in mixed case, and runs that lie partly in taken spans, not wholly."""
    spans = sorted((s, e) for _, s, e, _ in taken)
    starts = [s for s, _ in spans]
    reach = list(itertools.accumulate((e for _, e in spans), max))
    out = []
    for m in CANDIDATE.finditer(text):
        mixed = _DIGIT.search(m[0]) and _LETTER.search(m[0])
        if not mixed and not MIXED.search(m[0]):
            continue
        s, e = m.span()
        before = bisect.bisect_left(starts, e)
        touches = before and reach[before - 1] > s
        if not touches:
            if not mixed:
                out.append((s, e, m[0]))
            continue
        # within a single span it adds nothing
        at = bisect.bisect_right(starts, s)
        if not (at and reach[at - 1] >= e):
            out.append((s, e, m[0]))
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
_SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"


class _Smallest:
    """The distinct values of the smallest hashes."""

    def __init__(self, most: int) -> None:
        self.most, self.held = most, {}
        self.limit = 1 << 64

    def add(self, value: str) -> None:
        h = xxhash.xxh64_intdigest(value)
        if h < self.limit and len(value) <= LONGEST:
            self.held[value] = h
            if len(self.held) >= 2 * self.most:
                self.cut()

    def cut(self) -> dict[str, int]:
        best = sorted(self.held.items(), key=lambda x: (x[1], x[0]))[: self.most]
        self.held = dict(best)
        if len(best) == self.most:
            self.limit = best[-1][1] + 1
        return self.held


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from at most ``sample`` distinct values of each kind and of the background."""

    def run(batches):
        kept = {kind: _Smallest(sample) for kind in KINDS}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = base_spans(text or "")
                for kind, _, _, value in own:
                    kept[kind].add(value)
                for _, _, value in candidates(text or "", own):
                    kept["learned"].add(value)
        rows = [(kind, value, h - (1 << 63)) for kind, k in kept.items() for value, h in k.cut().items()]
        if rows:
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["kind", "value", "h"])

    small_batches(docs.sparkSession)
    values = narrow(docs, "text").mapInArrow(run, "kind string, value string, h long").groupBy("kind", "value", "h").agg(F.lit(1).alias("one"))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    found = values.withColumn("n", first).where(F.col("n") <= sample).select("kind", "value").collect()
    by_kind = {kind: [r.value for r in found if r.kind == kind] for kind in KINDS}
    return Formats({kind: v for kind, v in by_kind.items() if v and kind != "learned"}, by_kind["learned"])


MEMO = 100_000  # scores that a task remembers


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, spans, learned) for every row: base spans, and further spans with a score.

    Null text counts as empty.  Repeated rows and null ids are returned as they come; an empty table
    gives an empty result; further columns are ignored.  With no labelled value nothing is learned.
    """
    formats = formats or learn(docs)
    scored_type = pa.list_(pa.struct([*_SPAN.value_type, pa.field("score", pa.float64())]))

    def make():
        memo: dict[str, float] = {}

        def score(value: str) -> float:
            if value not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[value] = formats.score(value)
            return memo[value]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, learned = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text or "")
                spans.append([dict(zip(("kind", "start", "end", "value"), x)) for x in own])
                every = sorted(candidates(text or "", own) + further(text or "", own))
                learned.append([dict(kind="learned", start=s, end=e, value=v, score=x) for s, e, v in every if (x := score(v)) >= formats.threshold])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN), pa.array(learned, scored_type)], ["doc_id", "spans", "learned"])

        return step

    return map_texts(narrow(docs, "doc_id", "text"), make, f"doc_id long, spans {_SPAN_SQL}, learned {_SPAN_SQL[:-2]}, score: double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(x["kind"], x["start"], x["end"]) for x in base]
                n = [sum(k == kind for k, _, _ in own) for kind in KINDS[:3]]
                every = own + [(x["kind"], x["start"], x["end"]) for x in more]
                rows.append((*n, hashlib.sha256(_listed(own).encode()).hexdigest(), _listed(every)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return step

    return map_texts(scanned, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
