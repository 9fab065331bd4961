import hashlib
import random
import re

import pytest

from discloom.llm import conversations

BEGUN = re.compile(r"s?(ua)*u?")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each row ``(turn, role, text)``."""
    seen, found = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """Cost, edits and lines of the best repair: every prefix of edits that can still become legal is tried."""
    best = {((), ""): (0, "")}  # lines and initials so far, cost and edits
    marks = faults(rows)

    def grown(level):
        found = dict(level)
        for _ in range(2):
            for (lines, initials), (cost, audit) in list(found.items()):
                for role in ("user", "assistant"):
                    if BEGUN.fullmatch(initials + role[0]):
                        key, value = ((*lines, f"{role}:"), initials + role[0]), (cost + 2, audit + "I")
                        found[key] = min(found.get(key, value), value)
        return found

    for (_, role, text), fault in zip(rows, marks, strict=True):
        following = {}
        for (lines, initials), (cost, audit) in grown(best).items():
            ways = [(lines, initials, cost + 3, audit + "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways.append(((*lines, f"{role}:{text}"), initials + role[:1], cost + extra, audit + "K") if role else ways[0])
                ways += [((*lines, f"{r}:{text}"), initials + r[0], cost + 2 + extra, audit + "R") for r in ("user", "assistant")]
            for lines2, initials2, *value in ways:
                if BEGUN.fullmatch(initials2):
                    key = (lines2, initials2)
                    following[key] = min(following.get(key, tuple(value)), tuple(value))
        least = min(c for c, _ in following.values())
        best = {k: v for k, v in following.items() if v[0] <= least + 7}  # dearer ones never catch up
    ends = [(cost, audit, lines) for (lines, initials), (cost, audit) in grown(best).items() if LEGAL.fullmatch(initials)]
    return min(ends)


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    marks, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = tuple(marks.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines)


def some_rows(rng, most):
    texts = ["hello.", "so what", "", " \n", "fine!", "is it?", "no", "yes.\x0b ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    return [(rng.choice([None, i, i, i, i + 3]), rng.choice(roles if rng.random() < 0.3 else roles[:2]), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.") for i in range(rng.randint(1, most))]


@pytest.mark.parametrize(("unit", "fan_in"), [(256, 64), (2, 2)])
def test_repairs_are_the_cheapest_of_all(spark, monkeypatch, unit, fan_in):
    monkeypatch.setattr(conversations, "UNIT", unit)
    monkeypatch.setattr(conversations, "FAN_IN", fan_in)
    rng = random.Random(unit)
    convs = {c: some_rows(rng, 8) for c in [*range(60), None]}
    convs[7] = [(i, "user" if i % 2 == 0 else "assistant", f"x{i}.") for i in range(400)]
    convs[8] = [(5, "user", "same.")] * 40
    data = [(c, *r, "x", 1) for c, rows in convs.items() for r in rows]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string, conv string, part int").repartition(6)
    done = conversations.repair(df)
    lines = {}
    for r in done.rows.collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    report = {r.conv_id: r for r in done.report.collect()}
    digests = {r.conv: r.sha256 for r in done.digests().collect()}
    assert set(report) == set(convs) and done.report.schema["conv_id"].dataType.simpleString() == "int"
    for c, rows in convs.items():
        r = report[c]
        if c == 7:
            want = (0, 0, 0, 0, 0, 0, "K" * 400, tuple(f"{x}:{t}" for _, x, t in rows))
        elif c == 8:
            want = (0, 0, 39, 0, 39, 119, "K" + "D" * 39 + "I", ("user:same.", "assistant:"))
        else:
            want = expected(rows)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, tuple(lines.get(r.conv, ()))) == want, (c, rows)
        text = "\n".join(lines.get(r.conv, ()))
        assert digests.get(r.conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()


def test_no_rows(spark):
    done = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.report.collect() == [] and done.rows.collect() == [] and done.digests().collect() == []
