"""Repair of role sequences against trying every sequence of edits."""
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from spendweave.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """The contract's damage in plain Python: rows by conversation, in order."""
    out = {}
    for place, (conv_id, turn, role, text) in enumerate(rows):
        conversation = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        conversation += [(turn, place, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for k, v in out.items()}


def every_way(rows):
    """Least (cost, audit) and its lines, by trying all edits from the end."""
    legal = re.compile("(s?(ua)+)?")

    @lru_cache(None)
    def best(i, made, inserts):
        ways = []
        if i == len(rows):
            if legal.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[made]):
                ways.append((0, "", ()))
        else:
            initial, goes, truncated, line = rows[i]
            c, a, lines = best(i + 1, made, 0)
            ways.append((c + 4, "D" + a, lines))
            if not goes:
                if initial and initial in {"": "su", "s": "u", "u": "a", "a": "u"}[made]:
                    c, a, lines = best(i + 1, initial, 0)
                    ways.append((c + 3 * truncated, "K" + a, (line, *lines)))
                due = "a" if made == "u" else "u"
                c, a, lines = best(i + 1, due, 0)
                ways.append((c + 3 + 3 * truncated, "R" + a, ({"u": "user", "a": "assistant"}[due] + line[line.index(":"):], *lines)))
        if inserts < 3:
            due = "a" if made == "u" else "u"
            c, a, lines = best(i, due, inserts + 1)
            ways.append((c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[due], *lines)))
        return min(ways, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = []
    for conv_id, conversation in damaged(rows).items():
        seen, faults, parsed, blank, duplicate, truncated = set(), [], [], 0, 0, 0
        for turn, _, role, text in conversation:
            body = text.strip(" \t\n\r\x0b\x0c")
            is_blank, is_dup = not body, (role, text) in seen and bool(body)
            is_cut = not is_blank and not is_dup and body[-1] not in ".!?"
            seen.add((role, text))
            blank, duplicate, truncated = blank + is_blank, duplicate + is_dup, truncated + is_cut
            parsed.append((role[:1], is_blank or is_dup, is_cut, f"{role}:{text}"))
        initials = [p[0] for p in parsed]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, *_ in conversation if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = every_way(tuple(parsed))
        out.append((conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "and so on ", " \t", "", None, "Same text.", "漢字。", "end.\x85", "ok?\n"]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "useless", "sage", "ava"]
    return [(c, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.")
            for c in [*range(conversations), None] for t in range(rng.randint(1, most))]


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_every_way(spark):
    rows = random_rows(4, 120, 9)
    got = tuples(cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA).coalesce(1))))
    assert got == brute(rows)
    assert sum("R" in r[7] for r in got) > 20 and sum("I" in r[7] for r in got) > 20 and sum(r[7] == "" for r in got) >= 1


@pytest.mark.parametrize("length", [1, 2, 7])
def test_segments_make_no_difference(spark, length):
    """Conversations cut into short segments, over several partitions: the same repairs."""
    rows = random_rows(5, 6, 40)
    assert tuples(cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA).coalesce(1)), length)) == brute(rows)


def test_one_long_conversation_is_spread(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(6000)]
    made = cr.segments_of(cr.damage(spark.createDataFrame(rows, SCHEMA)))
    held = [len(p) for p in made.rdd.glom().collect()]
    assert sum(n > 0 for n in held) >= 4 and max(len(r.roles) for r in made.collect()) <= cr.SEGMENT_ROWS
    [row] = cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA))).collect()
    kept = len(damaged(rows)[7])
    assert len(row.audit.replace("I", "")) == kept


def test_grammar_by_its_automaton():
    frontier = [(cr.BOTTOM, "")]
    accepted = set()
    while frontier:
        stack, word = frontier.pop()
        if stack.accepts:
            accepted.add(word)
        if len(word) < 7:
            frontier += [(new, word + c) for c in "sua" if (new := cr.shift(stack, c))]
    words = {"".join(w) for n in range(8) for w in itertools.product("sua", repeat=n)}
    assert accepted == {w for w in words if re.fullmatch("(s?(ua)+)?", w)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damage(empty)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(dropped, 1, "user", "gone."), (None, None, None, None), (5, None, "user", "x" * 200_000)]
    got = {r.conv_id: r for r in cr.repair(cr.damage(spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA + ", key string, row long, copies int"))).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(got) == {dropped, None, 5}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)
