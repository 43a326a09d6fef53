import random
import re
from collections import Counter

from quillspark.llm import rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_base_figures_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(250):
        vocab = ["a", "é", "b#", "😀", "|", "C"] + [f"w{k}" for k in range(rnd.choice([1, 40, 2000]))]
        rows.append((i, "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "\t", "  ", "\x0b", " "]) for _ in range(rnd.choice([0, 1, 2, 3, 60, 400])))))
    rows += [(900, None), (901, ""), (902, " \n\t "), (None, "x y z x y z"), (3, "again"), (903, "the same words " * 9000), (904, "f off\nfff\n\ff half f"), (905, "f")]
    df = spark.createDataFrame([(d, t, None, "h", 1) for d, t in rows], DOCS)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(df).collect()]
    assert sorted(got, key=repr) == sorted(((d, *base(t)) for d, t in rows), key=repr)


def verdicts(rows, least, share=0.01):
    """(line_chars, removed_chars, kept) of rows (id, text, host): documents of a host that differ in their set of lines count."""
    lines = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    plain = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()
    texts, shared = {}, Counter()
    for _, t, host in rows:
        if lines(t):
            texts.setdefault(host, set()).add(frozenset(map(plain, lines(t))))
    for host, sets in texts.items():
        shared.update((host, x) for s in sets for x in s)
    out = []
    for _, t, host in rows:
        total = sum(map(len, lines(t)))
        gone = sum(len(x) for x in lines(t) if shared[host, plain(x)] > max(least, share * len(texts.get(host, ()))))
        out.append((total, gone, not base(t)[-1] and total - gone >= 0.5 * total))
    return out


def banners():
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    banner = words(70)
    rows = []
    for i in range(40):
        rows.append((i, f"{words(12)}\n{banner.upper() if i % 2 else banner}\n{words(4)}", "src"))  # mostly the banner
        rows.append((100 + i, f"{words(300)}\n  {banner}", "src"))  # mostly its own
        rows.append((200 + i, f"{banner}\n{words(12)}", None if i < 5 else "rare" + str(i)))
    own = [words(30) for _ in range(8)]
    rows += [(300 + i, "\n".join(own), "src") for i in range(60)]  # exact copies
    rows += [(400 + i, f"{banner}\n{words(12)}", None) for i in range(30)]
    return rows + [(500, None, "src"), (501, "", None), (501, "x", "src"), (None, banner, "src"), (502, "fff\n" + banner[:200] + "\nf", "src")], banner


def test_shared_lines_deplete_but_copies_do_not(spark):
    rows, banner = banners()
    df = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in rows], DOCS)
    got = [(r.doc_id, r.line_chars, r.removed_chars, r.kept) for r in rules.judge(df, least=20).collect()]
    want = verdicts(rows, 20)
    assert sorted(got, key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    # the method rejects what the base rules let pass, and copies of one text count once
    assert {r[0] for r, w in zip(rows, want) if not base(r[1])[-1] and not w[2]} == {*range(40), *range(200, 205), *range(400, 430), None}
    clean = {r.doc_id: r.text for r in rules.without_boilerplate(df, least=20).collect()}
    assert banner not in clean[0] and banner not in clean[100] and banner in clean[206] and clean[300] == rows[120][1] and clean[500] is None


def test_documents_that_share_most_lines_are_all_counted(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared = "\n".join(words(6) for _ in range(40))
    rows = [(i, f"{shared}\n{words(6)}", "h") for i in range(1000)] + [(2000 + i, words(80), "h") for i in range(100)]
    df = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in rows], DOCS)
    out = {r.doc_id: (r.removed_chars, r.kept) for r in rules.judge(df).collect()}
    assert all(out[i] == (len(shared) - 39, False) for i in range(1000)) and all(out[2000 + i] == (0, True) for i in range(100))


def test_equal_hashes_of_other_windows_are_not_repeats(spark):
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.choice([1, 1, 5]) for _ in range(n)) for n in (0, 2, 3, 9, 40, 300)]
    df = spark.createDataFrame([(i, t, None, "h", 1) for i, t in enumerate(texts)], DOCS)
    for window_hash in ("7L", "pmod(xxhash64(ws[int(i)]), 3L)"):
        got = {r.doc_id: r.n_repeat_words for r in rules.measured(df, window_hash).collect()}
        assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_columns_may_have_any_name(spark):
    rows, banner = banners()
    df = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in rows], DOCS).selectExpr("*", *[f"doc_id as `{c}`" for c in ("k", "row", "doc", "lines", "host", "gone", "h", "a.b")])
    assert rules.judge(df, least=20).where("not kept").count() == rules.judge(df.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")), least=20).where("not kept").count()
    clean = rules.without_boilerplate(df, least=20)
    assert clean.columns == df.columns and all(r.k == r.doc_id for r in clean.collect())
    assert rules.without_boilerplate(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], DOCS)).count() == 0
