"""Conversation repair against a plain dynamic programme over whole audits."""

import hashlib
import random
import re
import zlib

from ledgerline.llm import conversation_repair as R

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, key int, blk int, cost string"


def brute(rows):
    """Least (cost, audit) over all edits of (initial, must go, truncated)."""
    best = {"": (0, "")}  # emitted pattern state by its last letter, '' at the start
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(d):
        for _ in range(3):
            for q, (c, a) in list(d.items()):
                x = "u" if "u" in follow[q] else "a"
                d[x] = min(d.get(x, (10**9, "")), (c + 2, a + "I"))
        return d

    best = insert(best)
    for initial, gone, trunc in rows:
        new = {}

        def put(q, c, a):
            new[q] = min(new.get(q, (10**9, "")), (c, a))

        for q, (c, a) in best.items():
            put(q, c + 3, a + "D")
            if not gone:
                if initial and initial in follow[q]:
                    put(initial, c + trunc, a + "K")
                put("u" if "u" in follow[q] else "a", c + 2 + trunc, a + "R")
        best = insert(new)
    return min(best[q] for q in ("", "a") if q in best)


def expected(table):
    convs = {}
    for conv, turn, role, text, *_ in table:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        role = "user" if f == 4 else role
        mine += [(turn, role, text)] * (2 if f == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, lattice, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            blank, dup = not text.strip(WS), (role, text) in seen
            trunc = not blank and text.rstrip(WS)[-1] not in ".!?"
            seen.add((role, text))
            fault = 0 if blank else 1 if dup else 2 if trunc else None
            if fault is not None:
                faults[fault] += 1
            lattice.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = brute(lattice)
        lines, q, i = [], "", 0
        nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for e in audit:
            if e == "I":
                lines.append(nxt[q] + ":")
                q = nxt[q][0]
                continue
            role = rows[i][1] if e == "K" else nxt[q]
            if e != "D":
                lines.append(f"{role}:{rows[i][2]}")
                q = role[0]
            i += 1
        turns = {r[0] for r in rows if r[0] is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults,
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_lattice(r, n):
    return [(r.choice("suaxuaua") if r.random() > 0.05 else "", r.random() < 0.15, r.random() < 0.2) for _ in range(n)]


def test_search_equals_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        rows = random_lattice(r, r.randrange(0, 14))
        assert R.repair(rows) == brute(rows), rows


def test_long_conversation_is_found_fast():
    rows = [("u" if k % 2 == 0 else "a", k % 97 == 5, k % 89 == 3) for k in range(20_000)]
    assert R.repair(rows) == brute(rows)


def fixture():
    r = random.Random(7)
    said = ["Yes.", "No!", "", "  ", "open end", "Why?", "Ünïcode 😀.", "a\nb. \t", "x" * 3000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 12)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), r.choice(said)))
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", f"line {t % 40}.") for t in range(150)]  # spans blocks
    rows += [(None, t % 9 or None, r.choice(["user", "assistant", None]), r.choice([*said, None])) for t in range(60)]
    rows += [(71, None, "user", "Hi."), (71, None, "assistant", "Ho."), (72, 5, None, None), (73, 2**40, "user", "a.")]
    rows += [rows[3]] * 3 + [(74, 3, "system", "Only this.")] + [(75, 9, "user", "same.")] * 30
    return [(*x, "c", 1, 2, "d") for x in rows]


def result(df):
    return {r["conv"]: tuple(r[c.split()[0]] for c in R.RESULT.split(", ")) for r in df.collect()}


def test_conversations(spark):
    table = fixture()
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    want = expected(table)
    for block_rows in (R.BLOCK_ROWS, 7):
        got = result(R.repair_conversations(R.damage(df), block_rows))
        assert {k: v for k, v in got.items() if v != want.get(k)} == {}
        assert got.keys() == want.keys()


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = result(R.repair_conversations(R.damage(spark.createDataFrame([(1, gone, "user", "x", "", 1, 1, "")], SCHEMA))))
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(R.repair_conversations(R.damage(spark.createDataFrame([], SCHEMA)))) == {}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = R.op11_conversation_repair(spark, sf).withColumnsRenamed({"conv_id": "conv", "repaired_sha256": "sha256"})
    assert result(got) == expected(table)
