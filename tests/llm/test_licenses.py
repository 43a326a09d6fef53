import random

import pytest

from quillspark.llm import decontam, licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, templates):
    out = {}
    for d, t in docs:
        ws = decontam.words_of(t)
        for n, license, text in licenses.rows_of(templates):
            want = decontam.shingles_of(decontam.words_of(text))
            if len(decontam.words_of(text)) < 5:
                continue
            step = 1 << max(0, len(want) - 1).bit_length()
            for start in range(0, max(1, len(ws) - 4), step):
                part = {tuple(ws[i : i + 5]) for i in range(start, min(start + 2 * step, len(ws) - 4))}
                share = len(part & want) / len(want)
                if share >= 0.8 - 1e-9 and (share, -start) > out.get((d, license, n), (0, 0)):
                    out[d, license, n] = (share, -start)
    return sorted(((*k, round(s, 9), -b) for k, (s, b) in out.items()), key=repr)


def test_equals_exact_containment(spark):
    rnd = random.Random(6)
    notices = [t for v in licenses.TEMPLATES.values() for t in v]
    docs = []
    for i in range(150):
        filler = [rnd.choice(["on", "tion", "É", "the", "license", "2"]) for _ in range(rnd.choice([0, 10, 500]))]
        notice = rnd.choice(notices).split()
        if i % 4 == 0:
            notice[rnd.randrange(len(notice))] = "other"
        at = rnd.randint(0, len(filler))
        docs.append((i, rnd.choice([" ", "\n", " -- "]).join(filler[:at] + (notice if i % 5 else []) + filler[at:])))
    docs += [(500, None), (501, ""), (502, "mit"), (503, " ".join(notices * 40)), (None, notices[0]), (3, notices[0]), (3, notices[0]), (504, "word " * 60000 + notices[0].upper())]
    df = spark.createDataFrame([(d, t, None, None, 1) for d, t in docs], DOCS)
    templates = licenses.TEMPLATES | {"short": ["too short here"]}
    for block in (200, 7):
        got = licenses.matches(df, templates, block=block).collect()
        assert sorted(((r.doc_id, r.license, r.template, round(r.containment, 9), r.first_word) for r in got), key=repr) == brute(docs, templates)
    assert licenses.matches(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_licenses_from_a_table(spark):
    rnd = random.Random(7)
    vocab = [f"term{i}" for i in range(3000)]
    bank = [(f"l{k % 7}", " ".join(rnd.choice(vocab) for _ in range(n))) for k, n in enumerate([3, 40, 90, 300, 700, 1500, 2600, 6000])]
    bank += [("l0", None), ("again", bank[3][1])]
    docs = []
    for i, (_, t) in enumerate(bank):
        words = (t or "").split()
        changed = [w if rnd.random() > 0.03 else "changed" for w in words]
        filler = lambda n: [rnd.choice(["on", "the", "term7"]) for _ in range(n)]
        docs += [(10 * i, " ".join(filler(700) + words + filler(30))), (10 * i + 1, " ".join(filler(5) + changed)), (10 * i + 2, " ".join(words[: len(words) // 2]))]
    docs.append((900, " ".join(" ".join(filler(9)) + " " + bank[1][1] for _ in range(300))))
    df = spark.createDataFrame([(d, t, None, None, 1) for d, t in docs], DOCS)
    table = spark.createDataFrame([(k, t, 1) for k, t in bank], "license string, text string, template int").repartition(3)
    numbered = sorted(((k, t or "") for k, t in bank))
    want = {}
    for d, t in docs:
        ws = decontam.words_of(t)
        for n, (license, text) in enumerate(numbered):
            wanted = decontam.shingles_of(decontam.words_of(text))
            if len(decontam.words_of(text)) >= 5:
                step = 1 << max(0, len(wanted) - 1).bit_length()
                for start in range(0, max(1, len(ws) - 4), step):
                    share = len({tuple(ws[i : i + 5]) for i in range(start, min(start + 2 * step, len(ws) - 4))} & wanted) / len(wanted)
                    if share >= 0.8 - 1e-9 and (share, -start) > want.get((d, license, n), (0, 0)):
                        want[d, license, n] = (share, -start)
    got = {(r.doc_id, r.license, r.template): (r.containment, -r.first_word) for r in licenses.matches(df, table).collect()}
    assert got == want and len({n for _, _, n in got}) == 8
    assert licenses.matches(df, {}).count() == 0 and licenses.matches(df, table.limit(0)).count() == 0
    assert [x.split()[0] for x in licenses.RESULT.split(", ")] == licenses.matches(df, {}).columns == licenses.matches(df).columns


def test_columns_may_have_any_name(spark):
    notice = licenses.TEMPLATES["unlicense"][0]
    df = spark.createDataFrame([(1, notice, 2)], "doc_id long, text string, x int").selectExpr("*", "x as hs", "x as ws", "x as template", "x as start", "x as `a.b`")
    assert [r.license for r in licenses.matches(df).collect()] == ["unlicense"]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 9, 16, 17, 32, 33, 40, 64, 200, 5600])
def test_band_settings_guarantee_collisions(n):
    assert licenses.miss_bound(n) < 2e-5
