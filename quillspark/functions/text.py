"""Text and chunking expressions, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(WS))


def paragraphs(text: Column | str) -> Column:
    """Stripped, non-empty lines; null for null."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")


def check_sizes(size: int, overlap: int) -> None:
    if not 0 < overlap < size:
        raise ValueError(f"overlap must lie between 0 and the chunk size: {overlap}, {size}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hard_split(paragraph: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` code points in steps of ``size - overlap``, found in one pass over the paragraph."""
    return F.regexp_extract_all(paragraph, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"), F.lit(1))


def _prefix_sums(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values, by doubling the summed span."""

    def doubled(x: Column, span: Column) -> Column:
        return F.transform(x, lambda v, i: v + F.when(i >= span, F.get(x, i - span)).otherwise(F.lit(0)))

    spans = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(spans, F.concat(F.array(F.lit(0)), values), doubled)


FOLDED = 512  # paragraphs up to which starts are found one after another


def _folded_starts(lengths: Column, size: int) -> Column:
    """Where pieces start, by one step a paragraph; each step copies the starts so far."""

    def step(a: Column, n: Column) -> Column:
        fits = (a["held"] >= 0) & (a["held"] + n + 1 <= size)
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(fits, a["held"] + n + 1).when(n > size, F.lit(-1)).otherwise(n).alias("held"),
            F.when(fits, a["at"]).otherwise(F.array_append(a["at"], a["i"])).alias("at"),
        )

    nothing = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("held"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(lengths, nothing, step, lambda a: a["at"])


def _jumped_starts(lengths: Column, size: int) -> Column:
    """The same by n log n steps: a piece's end by binary search in prefix sums, and jumps along the ends, twice as far each time."""
    n = F.size(lengths)
    most = F.lit((size // 2 + 1).bit_length())  # a piece has half as many paragraphs as characters at most
    powers = F.sequence(F.least(F.length(F.bin(n.cast("long"))), most) - 1, F.lit(0), F.lit(-1))
    steps = F.transform(powers, lambda k: F.call_function("shiftleft", F.lit(1), k))

    def ends(t: Column) -> Column:
        def end(length: Column, i: Column) -> Column:
            def further(j: Column, step: Column) -> Column:
                return F.when((j + step <= n) & (F.get(t["sums"], j + step) <= F.get(t["sums"], i) + size + 1), j + step).otherwise(j)

            return F.when(length > size, i + 1).otherwise(F.aggregate(t["steps"], i + 1, further))

        return F.concat(F.transform(lengths, end), F.array(n))

    def jumped(a: Column, _: Column) -> Column:
        return F.struct(
            F.transform(a["to"], lambda j: F.get(a["to"], j)).alias("to"),
            F.concat(a["at"], F.transform(a["at"], lambda i: F.get(a["to"], i))).alias("at"),
        )

    found = let(F.struct(_prefix_sums(F.transform(lengths, lambda x: x + 1)).alias("sums"), steps.alias("steps")), ends)
    start = F.struct(found.alias("to"), F.array(F.lit(0)).alias("at"))
    starts = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n.cast("long")))), start, jumped, lambda a: a["at"])
    return F.filter(starts, lambda i: i < n)


def packed(paras: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed greedily, in order, into pieces of at most ``size`` code points.

    Only the paragraphs' lengths decide where pieces start; then each is cut out once, so a text's characters are copied a
    fixed number of times however long it is.
    """

    def cut(t: Column, starts: Column) -> Column:
        def piece(i: Column, k: Column) -> Column:
            joined = F.array_join(F.slice(t["p"], i + 1, F.coalesce(F.get(starts, k + 1), F.size(t["p"])) - i), "\n")
            return F.when(F.get(t["lengths"], i) > size, hard_split(F.get(t["p"], i), size, overlap)).otherwise(F.array(joined))

        return F.flatten(F.transform(starts, piece))

    def measured(p: Column) -> Column:
        return F.struct(p.alias("p"), F.transform(p, lambda x: F.length(x)).alias("lengths"))

    def starts(t: Column) -> Column:
        return F.when(F.size(t["p"]) <= FOLDED, _folded_starts(t["lengths"], size)).otherwise(_jumped_starts(t["lengths"], size))

    return let(let(paras, measured), lambda t: let(starts(t), lambda at: cut(t, at)))


def overlapped(pieces: Column, overlap: int) -> Column:
    """Each piece after the first starts with the tail of the piece before it, before that had a tail itself."""

    def tailed(all_pieces: Column) -> Column:
        return F.transform(
            all_pieces,
            lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get(all_pieces, i - 1), F.lit(overlap)), F.lit("\n"), c)),
        )

    return let(pieces, tailed)


def chunk_id(source: Column | str, index: Column | str) -> Column:
    return F.concat(source, F.lit("::chunk_"), index)


def suffix(path: Column | str) -> Column:
    """Lower-case file suffix with its dot; empty for names that only begin with a dot."""
    name = F.regexp_extract(path, r"[^/]+$", 0)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def place(path: Column | str) -> Column:
    """A text whose order is the component-wise order of paths."""
    return F.translate(path, "/", "\x01")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def fingerprint(c: Column | str) -> Column:
    return F.sha2(c, 256)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
