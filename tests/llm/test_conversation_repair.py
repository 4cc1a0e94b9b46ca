"""Conversation repair against a brute-force search, whole and in segments, and against SQL on the table."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")

from tessera.llm import conversation_repair as R  # noqa: E402
from tessera.llm import queries  # noqa: E402

WORD = re.compile(r"[^ \t-\r]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every edit; the state is what the initials read so far, shortened."""

    @lru_cache(None)
    def best(i, said, inserted):
        # said: '' nothing, 's', 'u' open, 'a' answered
        options = []
        if i == len(rows):
            if said in ("", "a"):
                options.append((0, "", ()))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follow:
                    c, a, o = best(i, role[0], inserted + 1)
                    options.append((c + 5, "I" + a, (f"{role}:", *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, o = best(i + 1, said, 0)
            options.append((c + 2, "D" + a, o))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                if role[:1] and role[0] in follow:
                    c, a, o = best(i + 1, role[0], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                for new in ("user", "assistant"):
                    if new[0] in follow:
                        c, a, o = best(i + 1, new[0], 0)
                        options.append((c + 1 + more, "R" + a, (f"{new}:{text}", *o)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 0)


def brute(rows):
    got = {}
    for conv in {r[0] for r in rows}:
        got[conv] = []
    for r in damage(rows):
        got[r[0]].append(r)
    out = {}
    for conv, mine in got.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faulty = set(), []
        for _, _, role, text in mine:
            chars = WORD.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        kinds = [f for _, _, f in faulty]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = cheapest(tuple(faulty))
        out[conv] = (conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


KIND = "conv_id long, turn long, role string, text string, cost int, audit int"


def some_rows(seed, convs=60, longest=14):
    r = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(r.randint(0, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "usher"])
            text = r.choice(["Hi.", "What?", "Ok", "é!", "", " \t", None, "a\nb.", "Hi. \n", "\xa0", f"t{r.random()}."])
            rows.append((c, r.choice([t, t, t, t + 1, None, 50]), role, text))
    return rows


@pytest.mark.parametrize("segment", [16_384, 8, 3, 1])
def test_repair_random(spark, monkeypatch, segment):
    """Segments of a few rows cut most conversations into pieces; results don't depend on it."""
    monkeypatch.setattr(R, "SEGMENT", segment)
    rows = some_rows(segment) + some_rows(99, 2, 90)
    want = brute(rows)
    got = R.damage_and_repair(spark.createDataFrame([(*r, 1, 2) for r in rows], KIND).repartition(3)).collect()
    assert {tuple(x) for x in got} == set(want.values()) and len(got) == len(want)


def test_repair_shuffles_where_ids_are_many(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 4)
    monkeypatch.setattr(R, "SMALL_IDS", 0)
    rows = some_rows(7)
    got = R.damage_and_repair(spark.createDataFrame([(*r, 1, 2) for r in rows], KIND)).collect()
    assert {tuple(x) for x in got} == set(brute(rows).values())


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from([None, None, None, "blank", "duplicate", "truncated"])), max_size=9))
@settings(max_examples=150, deadline=None)
def test_paths_are_cheapest_and_least(rows):
    faults = {None: R.NONE, "blank": R.BLANK, "duplicate": R.DUPLICATE, "truncated": R.TRUNCATED}
    codes = [max(0, "sua".find(r[0])) + 4 * faults[f] if r[0] in "sua" else R.OTHER + 4 * faults[f] for r, f in rows]
    assert R.solve(codes) == cheapest(tuple((r, "x", f) for r, f in rows))[:2]


def test_repeated_rows_and_empty_tables(spark):
    assert R.damage_and_repair(spark.createDataFrame([], KIND)).count() == 0
    rows = [(5, 1, "user", "Hi.")] * 40 + [(6, None, None, None)]
    got = R.damage_and_repair(spark.createDataFrame([(*r, 1, 2) for r in rows], KIND)).collect()
    assert {tuple(x) for x in got} == set(brute(rows).values())
    ends = R.repaired(spark.createDataFrame([(1, 2**63 - 1, "user", "a."), (1, -(2**63), "assistant", "b.")], "conv_id long, turn long, role string, text string")).first()
    assert ends.gaps == 2**63 - 1 and ends.illegal == 0


def test_repair_query(spark, sf, duck):
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, sf).collect()))
    assert got == sorted(duck.execute(queries.ORACLES["op12_conversation_repair"]).fetchall())
