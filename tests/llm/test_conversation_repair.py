"""Conversation repair against a plain search over all edits, in one partition and over many."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tracegauge.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def plain_repair(rows, faults):
    """Cheapest and first script by trying every edit at every place, from the end."""

    def after(out, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[out].get(initial)

    @cache
    def best(i, out, inserted):
        ways = [(0, "", ())] if i == len(rows) and out in ("", "a") else []
        if inserted < 2:
            for initial, role in (("u", "user"), ("a", "assistant")):
                to = after(out, initial)
                rest = best(i, to, inserted + 1) if to else None
                if rest:
                    ways.append((rest[0] + 2, "I" + rest[1], (f"{role}:", *rest[2])))
        if i < len(rows):
            role, text = rows[i][2:]
            rest = best(i + 1, out, 0)
            if rest:
                ways.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                stay = [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]
                for letter, cost, new in stay:
                    to = after(out, new[:1])
                    rest = best(i + 1, to, 0) if to else None
                    if rest:
                        ways.append((rest[0] + cost + (faults[i] == "truncated"), letter + rest[1], (f"{new}:{text}", *rest[2])))
        return min(ways) if ways else None

    return best(0, "", 0)


def plain_summary(rows):
    faults = plain_faults(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    roles = [r[2][:1] for r in rows]
    cost, audit, lines = plain_repair(rows, faults)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in plain_damage(rows):
        convs[r[0]].append(r)
    return {c: plain_summary(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))) for c, own in convs.items()}


def made(rnd, conv, n):
    words = ["Yes.", "No", "Why?", "Fine. ", "", " \n", "Go on", "Well!"]
    return [(conv, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(words) if rnd.random() < 0.5 else f"text {rnd.random()}" + rnd.choice([".", ""])) for t in range(n)]


def test_search_equals_all_edits():
    rnd = random.Random(5)
    for _ in range(400):
        rows = made(rnd, 1, rnd.randrange(9))
        faults = plain_faults(rows)
        numbers = {"": cr.NONE, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.TRUNCATED}
        codes = [cr.code(r[2][:1] if r[2][:1] in ("s", "u", "a") else "", numbers[f]) for r, f in zip(rows, faults)]
        letters, lines = [], []

        def give(letter, role, text):
            letters.append(letter)
            if role is not None:
                lines.append((role + b":" + text).decode())

        repair = cr.Repair(cr.START, give)
        for c, r in zip(codes, rows):
            repair.row(c, r[2].encode(), r[3].encode())
        cost = repair.close()
        assert (cost, "".join(letters), tuple(lines)) == plain_repair(rows, faults)


def test_edits_become_final_early():
    """A long conversation leaves few nodes, forced deletions none at all."""
    repair = cr.Repair(cr.START, lambda *edit: given.append(edit))
    given = []
    rnd, most = random.Random(1), 0
    for i in range(20000):
        role = "ua"[i % 2] if rnd.random() < 0.9 else rnd.choice("usa")
        repair.row(cr.code(role, rnd.choice([cr.NONE] * 8 + [cr.BLANK, cr.TRUNCATED])), b"r", b"t")
        most = max(most, i - len(given))
    assert most < 200
    for _ in range(1000):
        repair.row(cr.code("u", cr.DUPLICATE), b"r", b"t")
    nodes, todo = 0, [repair.root]
    while todo:
        node = todo.pop()
        nodes, todo = nodes + 1, todo + node.children
    assert nodes < 200
    repair.close()


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversations_over_partitions(spark, partitions):
    rnd = random.Random(partitions)
    rows = [r for c in range(30) for r in made(rnd, c, rnd.randrange(1, 9))] + made(rnd, 100, 300) + made(rnd, None, 40)
    rows += [(200, t, "user", f"only users {t}.") for t in range(150)]  # two survivors that never meet
    rows += [(201, t, "user", "the same.") for t in range(150)]
    rows += [(202, None, "user", "no turn."), (202, 3, "assistant", "then."), (203, None, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        repaired = cr.repair_damaged(table)
        got = {r.conv_id: tuple(r)[1:] for r in repaired.collect()}
        damaged = cr.damaged(table)
        conversations = cr.Conversations(damaged, F.col("present"), F.col("copy"))
        assert bool(conversations.enter) == (partitions > 1)
        edits = conversations.edits().orderBy("conv_id", "part", "seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)
    for conv, want in expected(rows).items():
        own = [e for e in edits if e.conv_id == conv]
        assert "".join(e.edit for e in own) == want[6]
        kept = "\n".join(f"{e.role}:{e.text}" for e in own if e.edit != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == want[7]


def test_rows_of_one_turn_and_long_texts(spark):
    """Equal rows are neighbours whatever order the table has; nothing is cut."""
    long = "word " * 300_000
    rows = [(1, 0, "user", "b."), (1, 0, "user", "a."), (1, 0, "user", "b."), (1, 1, "assistant", long + "x."), (1, 2, "user", long + "y."), (1, 3, "assistant", long)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS code", "0 AS seq")
    edits = cr.Conversations(table).edits().orderBy("seq").collect()
    assert "".join(e.edit for e in edits) == "KIKDKKK" and [e.text for e in edits[:3]] == ["a.", "", "b."]
    assert [len(e.text or "") for e in edits][-3:] == [len(long) + 2, len(long) + 2, len(long)]


def test_empty_table(spark):
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cr.Conversations(spark.createDataFrame([], SCHEMA)).edits().count() == 0
