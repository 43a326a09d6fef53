r"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

Templates are short license notices and opening passages of licenses, or whole licenses from a table.  Texts and templates
become five-word shingles.  Templates are tiered by the power of two L above their number of shingles; a tier
slides windows of 2L shingles in steps of L over the text, so an occurrence lies whole in some window.
A MinHash band is one bin of a one-permutation sketch: bin = low bits of the shingle's hash, value = the
smallest hash in the bin.  A window retrieves a template when they agree in a band.

Tiers from L = 16 have 8L bins: a shared shingle is its bin's minimum on both sides with probability
above 0.83.  A template has ``BANDS`` bands at most, chosen by hash, so one with 80 % of its shingles in a window is
missed with probability below (1 - 0.8 * 0.83)^32 < 1e-14, and a short one, all of whose bins are bands, with
probability below (1 - 0.83)^8 < 1e-6.  Smaller tiers have 2^20 bins, where even a single shared
shingle is lost with probability below 2L / 2^20 (see ``miss_bound``).

Band values are looked up lazily: a text's window minima matter only where they can equal a template's
band value, so only shingles with such a hash have their windows' bins evaluated, and a window is taken up once for a
template, at the first such shingle.  Every match is verified
by the exact share of the template's word shingles in the window.  Nothing but results is shuffled.  Templates are
looked up in blocks bounded by the bytes of their texts; a block's bands and shingles are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 200  # templates that are looked up in one pass over the texts
BLOCK_BYTES = 2 << 20  # of their texts
BANDS = 32  # of a template

# Wording of common license notices.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

_BREAK = r"[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
_HASH = "xxhash64(" + ", ".join(f"ws[int(i) + {k}]" for k in range(SHINGLE)) + ")"


def rows_of(templates: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    return [(n, license, text) for n, (license, text) in enumerate((k, t) for k, v in sorted(templates.items()) for t in v)]


def tier_of(shingles: int) -> tuple[int, int]:
    """(L, bins) of a template."""
    step = 1 << max(0, shingles - 1).bit_length()
    return step, 8 * step if step >= 16 else 1 << 20


def miss_bound(shingles: int, threshold: float = THRESHOLD) -> float:
    """Upper bound of the probability that a window with the template's share of shingles shares no band."""
    step, bins = tier_of(shingles)
    lost = 1 - (1 - math.exp(-2 * step / bins)) / (2 * step / bins) * (1 - math.exp(-shingles / bins)) / (shingles / bins)
    lost = max(lost, 0.0)
    if shingles <= BANDS:
        return lost ** math.ceil(threshold * shingles - 1e-9)
    return (1 - threshold * (1 - lost)) ** BANDS


def _shingled(df: DataFrame) -> DataFrame:
    """Adds ws (words) and hs (a hash for each five-word shingle) to a table with text t."""
    worded = df.withColumn("ws", F.expr(f"array_remove(split(lower(t), '{_BREAK}'), '')"))
    return worded.withColumn(
        "hs", F.expr(f"if(size(ws) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0L, size(ws) - {SHINGLE}L), i -> {_HASH}))")
    )


def _texts(t: str) -> str:
    """A text for each shingle, by single elements, as a slice copies the whole array first."""
    each = f"transform(sequence(0, size({t}) - {SHINGLE}), k -> concat_ws(' ', " + ", ".join(f"{t}[k + {i}]" for i in range(SHINGLE)) + "))"
    return f"if(size({t}) < {SHINGLE}, cast(array() as array<string>), {each})"


def _class(text: str) -> int:
    """Templates of one class share a grid of windows: steps up to 64, 1024, 16384, ..."""
    return max(0, -(-(tier_of(len(text.split()))[0].bit_length() - 7) // 4))


def _blocks(docs: DataFrame, templates, block: int):
    """Blocks of (template, license, text), bounded by number, bytes and class."""
    if isinstance(templates, DataFrame):
        order = Window.orderBy(F.col("license").asc_nulls_first(), F.col("text").asc_nulls_first())
        # a table of licenses is short next to the texts
        numbered = templates.select("license", "text").withColumn("template", F.row_number().over(order) - 1)
        rows = ((r.template, r.license, r.text or "") for r in numbered.orderBy(F.length("text"), "template").toLocalIterator())
    else:
        rows = iter(sorted(rows_of(TEMPLATES if templates is None else templates), key=lambda r: (len(r[2]), r[0])))
    held, size = [], 0
    for row in rows:
        if held and (len(held) >= block or size + len(row[2]) > BLOCK_BYTES or _class(row[2]) != _class(held[0][2])):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield held


RESULT = "doc_id bigint, license string, template int, n_shingles bigint, containment double, first_word bigint"


def matches(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, license, template, n_shingles, containment, first_word) of every template found.

    ``templates`` are lists of texts by license, or a table (license, text), whose texts are numbered in order of both.
    One row for each doc_id and template: its best window, the first of equals; ``first_word`` is the word
    where that window begins.  Words are runs of ASCII letters and digits and of characters beyond ASCII, in
    lower case.  Templates need five words; shorter ones match nothing, and nor does an empty bank.  Null and short
    texts match nothing.  Rows that share a doc_id, null included, are reported together.  An empty table gives an
    empty result; further columns are ignored.
    """
    out = None
    for held in _blocks(docs, templates, block):
        found = _matches(docs, held, threshold)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def _bands(hashes: list[int]) -> tuple[int, int, list[int]]:
    """(step, bins, band values) of a template: the minima of its bins, the first ``BANDS`` by another hash."""
    step, bins = tier_of(len(hashes))
    least: dict[int, int] = {}
    for h in hashes:
        least[h & (bins - 1)] = min(h, least.get(h & (bins - 1), h))
    return step, bins, sorted(least.values(), key=lambda h: (h * 0x9E3779B97F4A7C15 % (1 << 64), h))[:BANDS]


def _matches(docs: DataFrame, block: list[tuple[int, str, str]], threshold: float) -> DataFrame:
    spark = docs.sparkSession
    # no filter here: Spark would push it below the words and split the text anew for each shingle
    bank = _shingled(spark.createDataFrame(block, "template int, license string, t string"))
    # a block's hashes are bounded by its bytes
    bands, grid = [], 1
    for r in bank.select("template", "license", F.array_distinct("hs").alias("hs")).collect():
        if not r.hs:
            continue
        step, bins, keys = _bands(r.hs)
        grid = max(grid, step)
        bands += [(k, r.template, r.license, step, bins, keys) for k in keys]
    table = spark.createDataFrame(bands, "x bigint, template int, license string, step bigint, bins bigint, keys array<bigint>")
    wanted = bank.select("template", F.array_distinct(F.expr(_texts("ws"))).alias("shingles"))
    keys = sorted({b[0] for b in bands}) or [0]
    hashed = _shingled(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))).select("doc_id", "ws", "hs")
    is_key = f"hs[int(i)] in ({', '.join(f'{k}L' if k != -(1 << 63) else 'bigint(-9223372036854775808)' for k in keys)})"
    # positions of band values, by blocks of the grid
    none = "cast(array() as array<bigint>)"
    spread = f"transform(sequence(0L, (size(hs) - 1L) div {grid}), b -> filter(sequence(b * {grid}, least((b + 1) * {grid}, size(hs)) - 1L), i -> {is_key}))"
    # a long text goes on as the blocks with hits, each with what any window of its hits can reach
    near = f"""transform(if(size(hits) = 0, {none}, filter(sequence(0L, size(hits) - 1L), b -> size(hits[int(b)]) > 0)), b -> struct(
      greatest(0L, (b - 2) * {grid}) as low,
      hits[int(b)] as at,
      concat(coalesce(get(hits, int(b - 2)), {none}), coalesce(get(hits, int(b - 1)), {none}), hits[int(b)]) as hits,
      slice(hs, int(greatest(0L, (b - 2) * {grid})) + 1, {5 * grid}) as hs,
      slice(ws, int(greatest(0L, (b - 2) * {grid})) + 1, {5 * grid + SHINGLE - 1}) as ws))"""
    spread = f"if(size(hs) = 0, cast(array() as array<array<bigint>>), {spread})"
    hit = hashed.withColumn("hits", F.expr(spread))
    # an outer explode, as Spark would compute the array of a plain one twice, the first time to filter
    blocks = hit.select("doc_id", F.explode_outer(F.expr(near)).alias("b")).where("b is not null")
    one = blocks.select("doc_id", "b.low", "b.hits", "b.hs", "b.ws", F.explode("b.at").alias("i")).withColumn("x", F.expr("hs[int(i - low)]"))
    # BANDS rows a template of a block
    paired = one.join(F.broadcast(table), "x")
    windows = paired.withColumn("start", F.explode(F.expr("filter(array((i div step) * step, (i div step - 1) * step), s -> s >= 0)")))
    first = windows.where("not exists(filter(hits, a -> a >= start and a < i), a -> array_contains(keys, hs[int(a - low)]))")
    cut = first.select(
        "doc_id", "license", "template", "bins", "keys", "start",
        F.expr("slice(hs, int(start - low) + 1, int(2 * step))").alias("hs"),
        F.expr(f"slice(ws, int(start - low) + 1, int(2 * step) + {SHINGLE - 1})").alias("ws"),
    )
    agreed = cut.where("exists(array_intersect(keys, hs), k -> array_min(filter(hs, y -> (y & (bins - 1)) = (k & (bins - 1)))) = k)")
    shared = agreed.join(F.broadcast(wanted), "template")
    share = F.expr(f"size(array_intersect(shingles, {_texts('ws')})) / size(shingles)")
    checked = shared.select("doc_id", "license", "template", F.size("shingles").cast("long").alias("n_shingles"), share.alias("containment"), "start")
    best = checked.where(F.col("containment") >= threshold - 1e-9).groupBy("doc_id", "license", "template", "n_shingles")
    top = F.max(F.struct("containment", (-F.col("start")).alias("back")))
    return best.agg(top.alias("top")).select(
        "doc_id", "license", "template", "n_shingles", F.col("top.containment").alias("containment"), (-F.col("top.back")).alias("first_word")
    )


def oracle_sql(templates: dict[str, list[str]] | None = None) -> str:
    """Exact containment in the method's windows, with no bands."""
    word = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    values = ", ".join(f"({n}, '{license}', '{text.replace(chr(39), chr(39) * 2)}')" for n, license, text in rows_of(TEMPLATES if templates is None else templates))
    return rf"""
WITH t AS (SELECT template, license, regexp_extract_all(lower(text), '{word}') AS ws FROM (VALUES {values}) v(template, license, text)),
ts AS (SELECT DISTINCT template, license, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM t WHERE len(ws) >= 5),
tn AS (SELECT template, license, count(*) AS n_shingles, (2 ** ceil(log2(count(*))))::bigint AS step FROM ts GROUP BY ALL),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS ws FROM documents),
d AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, len(ws) - 3)) u(i)),
m AS (SELECT doc_id, license, template, n_shingles, step, i, s FROM d JOIN ts USING (s) JOIN tn USING (template, license)),
x AS (SELECT doc_id, license, template, n_shingles, unnest([(i // step) * step, (i // step - 1) * step]) AS start, s FROM m),
c AS (SELECT doc_id, license, template, n_shingles, start, count(DISTINCT s)::double / n_shingles AS containment FROM x WHERE start >= 0
  GROUP BY doc_id, license, template, n_shingles, start)
SELECT doc_id, license, template::int AS template, n_shingles, max(containment) AS containment, arg_min(start, (-containment, start)) AS first_word
FROM c WHERE containment >= {THRESHOLD} - 1e-9 GROUP BY doc_id, license, template, n_shingles
"""
