import functools
import hashlib
import random
import re
import zlib

from quillspark.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
WORDISH = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit) over all edits, by suffixes; more than three inserts side by side are never cheapest."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    # inserts alone would go round for ever, so at most two stand together, which is all that can be cheapest
    @functools.cache
    def bounded(i, role, inserts):
        found = [(0, "")] if i == len(rows) and role in ("", "a") else []
        if inserts < 3:
            cost, audit = bounded(i, after[role], inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            fault, initial = rows[i]
            cost, audit = bounded(i + 1, role, 0)
            found.append((cost + 3, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if initial == after[role] or initial == "s" and role == "":
                    cost, audit = bounded(i + 1, initial, 0)
                    found.append((cost + more, "K" + audit))
                cost, audit = bounded(i + 1, after[role], 0)
                found.append((cost + more + 2, "R" + audit))
        return min(found, default=(10**9, ""))

    for i in reversed(range(len(rows))):  # so that no recursion runs deep
        for role in after:
            bounded(i, role, 0)
    return bounded(0, "", 0)


def brute(rows, damage=True):
    """Rows (conv_id, turn, role, text) to the operator's rows."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        kept = convs.setdefault(conv, [])
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            marks = WORDISH.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(zip(faults, initials)))
        lines, role, i = [], "", 0
        for letter in audit:
            follows = "u" if role != "u" else "a"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[follows])
                role = follows
                continue
            _, own, text = kept[i]
            i += 1
            if letter == "D":
                continue
            role = own[:1] if letter == "K" else follows
            lines.append((own if letter == "K" else {"u": "user", "a": "assistant"}[follows]) + ":" + text)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and i == len(kept)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return out


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(0, 9)):
            turn = None if rnd.random() < 0.05 else turn * rnd.choice([1, 1, 1, 2])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "agent"])
            text = rnd.choice(["Yes.", "No", "", " \n", None, "What? ", "a b!\t", f"w{rnd.randint(0, 99)}.", "é…"])
            rows.append((None if conv == 7 else conv, turn, role, text))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    rnd.shuffle(rows)
    return rows


def result(spark, rows, damage=True):
    return sorted(map(tuple, repair.repair(spark.createDataFrame(rows, ROWS), damage).collect()), key=repr)


def test_rows_equal_brute_force(spark):
    rows = made(500, 1)
    assert result(spark, rows) == sorted(brute(rows), key=repr)
    assert result(spark, rows, damage=False) == sorted(brute(rows, damage=False), key=repr)


def test_programme_equals_all_edits():
    rnd = random.Random(2)
    name = {repair.FINE: "", repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.CUT: "truncated"}
    for _ in range(4000):
        rows = [(rnd.choice([0, 0, 0, 1, 2, 3, 3]), rnd.choice("suaauux")) for _ in range(rnd.randint(0, 9))]
        assert repair.Programme(rows).solve() == cheapest(tuple((name[f], r) for f, r in rows)), rows


def test_a_conversation_of_which_nothing_is_left(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(lost, 0, "user", "Hi.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_and_long_texts(spark):
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"t{t}" + rnd.choice([".", ""])) for t in range(1500)] + [(2, 0, "user", "long. " * 100_000), (2, 1, "assistant", "x" * 500_000)]
    assert result(spark, rows, damage=False) == sorted(brute(rows, damage=False), key=repr)


def test_empty_table_and_clashing_columns(spark):
    assert repair.repair(spark.createDataFrame([], ROWS)).count() == 0
    rows = made(40, 5)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", *[f"turn as `{c}`" for c in ("kind", "digest", "fault", "audit", "col", "code", "a.b")])
    assert sorted(map(tuple, repair.repair(df).collect()), key=repr) == result(spark, rows)
