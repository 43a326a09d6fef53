r"""Quality rules with cross-document line frequency, with DataFrame functions only.

Base rules look at one document.  The method looks across documents: lines are normalised (lower case, white
space collapsed) and hashed, the distinct documents of each (host, line) are counted, lines above the
host's limit, max(LEAST, SHARE of its distinct documents), are boilerplate, and a document is rejected when boilerplate makes up most of it.

Documents of a host are distinct if their sets of lines are: exact copies count once, near copies each on their
own, so a host's many edited copies of one text deplete each other.  Host is the column ``source``.

Texts are read once; from then on only counts and line hashes travel.  The counts are pre-aggregated
before each shuffle, so a line or host that holds a third of all rows costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

LEAST = 3  # documents that may share a line in a host of few; in larger ones the share decides
SHARE = 0.01  # of the host's distinct documents
DEPLETED = 0.5  # share of a document's characters, in lines with a word, that must remain
MIN_WORDS = 50
REPEAT_PERCENT = 50
_STRIP = r"' \t\n\u000B\u000C\r'"


def _words(text: str) -> str:
    stripped = f"btrim({text}, {_STRIP})"
    return rf"if({stripped} = '', cast(array() as array<string>), split({stripped}, '[\\x20\\x09-\\x0D]+'))"


# The words of window x equal those of window y.
_SAME = " and ".join(f"ws[int({{x}}) + {k}] = ws[int({{y}}) + {k}]" for k in range(3))
_HASH = "xxhash64(ws[int(i)], ws[int(i) + 1], ws[int(i) + 2])"


def _repeated(window_hash: str = _HASH) -> str:
    """Starts of three-word windows found twice or more, exactly.

    Each number holds a window's hash above its position, whose bits it takes as needed (`bits`), so that sorting puts
    equal hashes side by side.  Where neighbours of one hash differ in words, all windows are sorted by their words.
    """
    packed = f"sort_array(transform(sequence(0L, n_words - 3), i -> shiftleft({window_hash}, bits) | i))"
    at = lambda x: f"({x} & (shiftleft(1L, bits) - 1L))"
    alike = lambda x, y: f"shiftright({x}, bits) = shiftright({y}, bits)"
    clash = f"size(filter(s, (x, i) -> i > 0 and {alike('x', 's[i - 1]')} and not ({_SAME.format(x=at('x'), y=at('s[i - 1]'))}))) > 0"
    hashed = f"""transform(filter(s, (x, i) -> (i > 0 and {alike('x', 's[i - 1]')}) or (i < n_words - 3 and {alike('x', 's[i + 1]')})), x -> {at('x')})"""
    worded = """transform(array(sort_array(transform(sequence(0L, n_words - 3), i -> struct(ws[int(i)] as a, ws[int(i) + 1] as b, ws[int(i) + 2] as c, i as i)))),
      w -> transform(filter(w, (x, k) -> (k > 0 and x.a = w[k - 1].a and x.b = w[k - 1].b and x.c = w[k - 1].c)
        or (k < n_words - 3 and x.a = w[k + 1].a and x.b = w[k + 1].b and x.c = w[k + 1].c)), x -> x.i))[0]"""
    return f"transform(array({packed}), s -> if({clash}, {worded}, {hashed}))[0]"


def _covered(window_hash: str = _HASH) -> str:
    """Words covered by windows that start at p1 < p2 < ...: three, then at most three for each further one."""
    return f"""transform(array(sort_array({_repeated(window_hash)})), p ->
  aggregate(transform(p, (x, i) -> if(i = 0, 3L, least(3L, x - p[i - 1]))), 0L, (a, x) -> a + x))[0]"""


_LINE_HASH = rf"cast(conv(substring(md5(cast(lower(regexp_replace(btrim(l, {_STRIP}), '[\\x20\\x09-\\x0D]+', ' ')) as binary)), 1, 15), 16, 10) as bigint)"


def measured(docs: DataFrame, window_hash: str = _HASH) -> DataFrame:
    """One narrow row per document: base figures, and (hash, characters) of its lines with a word.

    The figures are exact whatever ``window_hash`` is; it decides only how fast they are found.
    """
    text = docs.select("doc_id", F.col("source").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = text.select(
        "doc_id", "host", "t", F.expr(_words("t")).alias("ws"), F.expr(rf"filter(split(t, '\\n'), l -> btrim(l, {_STRIP}) <> '')").alias("lines")
    )
    counted = words.select("*", F.size("ws").cast("long").alias("n_words"))
    return counted.select("*", F.length(F.bin("n_words")).alias("bits")).select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(f"if(n_words < 3, 0L, {_covered(window_hash)})").alias("n_repeat_words"),
        F.expr(f"transform(lines, l -> struct({_LINE_HASH} as h, cast(length(l) as bigint) as n))").alias("lines"),
    )


def boilerplate(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, h): lines in more distinct documents of a host than its limit."""
    # distinct documents of a host first, by the set of their lines: copies end here
    sets = rows.select("host", F.expr("array_sort(array_distinct(transform(lines, x -> x.h)))").alias("hs"))
    distinct = sets.where("size(hs) > 0").groupBy("host", "hs").agg(F.lit(1).alias("one")).select("host", "hs")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n"))
    counts = distinct.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    limit = F.greatest(F.lit(least), F.col("n") * share)
    frequent = counts.where(F.col("n_docs") > least)
    named = frequent.withColumnRenamed("host", "k")
    return named.join(hosts, F.col("k").eqNullSafe(F.col("host"))).where(F.col("n_docs") > limit).select("host", "h")


def _boilerplate_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(row, l): the lines of ``rows`` that are boilerplate of their host."""
    lines = rows.select("row", F.col("host").alias("k"), F.explode("lines").alias("l"))
    return lines.join(common, F.col("k").eqNullSafe(F.col("host")) & (F.col("l.h") == F.col("h"))).select("row", "l")


def judge(docs: DataFrame, least: int = LEAST, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row per document with base figures, line_chars, removed_chars, base_failed and kept.

    Null text counts as empty.  A null host is a host of its own.  Repeated rows and null ids are returned as
    they come; an empty table gives an empty result; further columns are ignored.
    """
    rows = stored(measured(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    common = stored(boilerplate(rows, least, share), "boilerplate")
    removed = _boilerplate_lines(rows, common).groupBy("row").agg(F.sum("l.n").alias("removed"))
    total = F.expr("aggregate(transform(lines, x -> x.n), 0L, (a, x) -> a + x)")
    out = rows.join(removed, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        total.alias("line_chars"),
        F.coalesce("removed", F.lit(0)).alias("removed_chars"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    left = F.col("line_chars") - F.col("removed_chars") < depleted * F.col("line_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~left)


def without_boilerplate(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``docs`` with boilerplate lines cut from the texts; a null text stays null, and other columns may have any name.

    What is cut is gathered by row, so it is bounded by a row's own lines and no host is held in one task.
    """
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    whole = stored(whole, "texts")
    lines = F.expr(rf"transform(filter(split(coalesce(doc.text, ''), '\\n'), l -> btrim(l, {_STRIP}) <> ''), l -> struct({_LINE_HASH} as h, cast(length(l) as bigint) as n))")
    rows = stored(whole.select("row", F.col("doc.source").alias("host"), lines.alias("lines")), "lines")
    cut = _boilerplate_lines(rows, boilerplate(rows, least, share)).groupBy("row").agg(F.collect_set("l.h").alias("gone"))
    kept = F.expr(rf"array_join(filter(split(doc.text, '\\n'), l -> btrim(l, {_STRIP}) = '' or not array_contains(gone, {_LINE_HASH})), '\n')")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)
    return whole.join(cut, "row", "left").select(*[text.alias("text") if c == "text" else F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns])


_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS lines FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(3) x(k) GROUP BY r),
ln AS (SELECT r, host, length(l) AS n,
  ('0x' || substr(md5(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')))), 1, 15))::bigint AS h FROM (SELECT r, host, unnest(lines) AS l FROM w)),
sets AS (SELECT DISTINCT host, hs FROM (SELECT r, host, list_sort(list_distinct(list(h))) AS hs FROM ln GROUP BY r, host)),
hosts AS (SELECT host, count(*) AS n FROM sets GROUP BY host),
cnt AS (SELECT host, h, count(*) AS n_docs FROM (SELECT host, unnest(hs) AS h FROM sets) GROUP BY host, h),
boil AS (SELECT c.host, c.h FROM cnt c JOIN hosts s ON c.host IS NOT DISTINCT FROM s.host WHERE c.n_docs > greatest({LEAST}, s.n * {SHARE})),
rem AS (SELECT ln.r, sum(ln.n)::bigint AS removed FROM ln JOIN boil b ON ln.host IS NOT DISTINCT FROM b.host AND ln.h = b.h GROUP BY ln.r),
tot AS (SELECT r, sum(n)::bigint AS total FROM ln GROUP BY r),
o AS (
  SELECT w.doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words,
    coalesce(tot.total, 0) AS line_chars, coalesce(rem.removed, 0) AS removed_chars
  FROM w LEFT JOIN cov USING (r) LEFT JOIN tot USING (r) LEFT JOIN rem USING (r)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND NOT (line_chars - removed_chars < {DEPLETED} * line_chars) AS kept
FROM o
"""
