"""Conversation repair against trying every edit, and against a plain search over strings."""

import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

from vigil.llm import conversations as C

PATTERN = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """{conv: rows (turn, role, text) in order} after damage."""
    out = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        mine += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def flags(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_strings(rows):
    """Cheapest (cost, audit, repaired) by relaxing whole strings."""
    fl = flags(rows)
    best = {"": (0, "", ())}

    def state(turns):
        s = "".join(r[:1] for r, _ in turns)
        return None if not re.fullmatch("s?(ua)*u?", s) else "" if not s else s if s == "s" else s[-1]

    def relax(into, cost, audit, turns):
        g = state(turns)
        if g is not None and (g not in into or (cost, audit) < into[g][:2]):
            into[g] = (cost, audit, turns)

    def inserted(best):
        for _ in range(3):
            for cost, audit, turns in list(best.values()):
                for r in ("user", "assistant"):
                    relax(best, cost + 5, audit + "I", (*turns, (r, "")))
        return best
    for (_, role, text), f in zip(rows, fl):
        new = {}
        for cost, audit, turns in inserted(best).values():
            relax(new, cost + 2, audit + "D", turns)
            if f in ("", "truncated"):
                more = 5 * (f == "truncated")
                if role[:1]:
                    relax(new, cost + more, audit + "K", (*turns, (role, text)))
                for r in ("user", "assistant"):
                    relax(new, cost + 1 + more, audit + "R", (*turns, (r, text)))
        best = new
    return min(v for g, v in inserted(best).items() if g in ("", "a"))


def by_trying(rows, most_inserts=2):
    """Cheapest (cost, audit) over all edit sequences of short conversations with few inserts."""
    fl, best = flags(rows), None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for f in fl]
    gaps = [c for n in range(most_inserts + 1) for c in product(range(len(rows) + 1), repeat=n) if list(c) == sorted(c)]
    for edits in product(*choices):
        for at in gaps:
            for what in product("ua", repeat=len(at)):
                cost, audit, out = 5 * len(at), "", ""
                for i in range(len(rows) + 1):
                    for p, w in zip(at, what):
                        if p == i:
                            audit, out = audit + "I", out + w
                    if i < len(rows):
                        e = edits[i]
                        audit += e if e in "KD" else "R"
                        cost += 2 if e == "D" else (e != "K") + 5 * (fl[i] == "truncated")
                        out += "" if e == "D" else (rows[i][1][:1] or "?") if e == "K" else e
                if PATTERN.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def plain(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        fl, initials = flags(mine), [r[1][:1] for r in mine]
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, left = by_strings(mine)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fl.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def conversation(rng, conv, n):
    texts = ["Yes.", "No", "Why?", " ", "", None, "a b.", "x\n", "ok! ", "same.", "Done.\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usr", "Assistant"]
    rows, turn = [], rng.choice([0, 0, -3, 7])
    for i in range(n):
        role = roles[i % 2] if rng.random() < 0.6 else rng.choice(roles)
        rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randrange(99)}" + rng.choice([".", "", "?"])))
        turn += rng.choice([1, 1, 1, 0, 2])
    return rows


def many(seed, n=60):
    rng = random.Random(seed)
    rows = [r for c in range(n) for r in conversation(rng, c, rng.choice([1, 2, 3, 5, 8, 20]))]
    rows += conversation(rng, 1000, 300) + conversation(rng, None, 30) + [(2000, t, "user", "again.") for t in range(150)] + [(2001, 5, "user", "copy.")] * 40
    rows += [(3000 + c, 0, "user", "Hi.") for c in range(60)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return {r["conv"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_string_search_equals_trying_everything():
    rng = random.Random(11)
    for c in range(120):
        rows = damaged(conversation(rng, c, rng.randint(0, 4))).get(c, [])[:4]
        assert by_strings(rows)[:2] == by_trying(rows)


@pytest.mark.parametrize("seed,piece", [(1, None), (2, 7), (3, 3)])
def test_repair_matches_the_plain_search(spark, seed, piece):
    rows = many(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = got(C.repair_digests(C.damage(df), piece))
    want = plain(rows)
    assert set(out) == set(want)
    assert {c: (out[c], want[c]) for c in want if out[c] != want[c]} == {}


@pytest.mark.parametrize("mod,piece", [((1 << 61) - 1, 4096), (3, 4096), (3, 4)])
def test_pieces_with_colliding_hashes(monkeypatch, mod, piece):
    monkeypatch.setattr(C, "_MOD", mod)
    for conv, rows in damaged(many(6, 150)).items():
        whole = C.Joined(conv)
        for a in range(0, len(rows) or 1, piece):
            p = C.Piece(conv, range(4) if a else (C.NONE,))
            for (turn, role, _), f in list(zip(rows, flags(rows)))[a:a + piece]:
                p.add(turn, role[:1], f == "blank", f == "duplicate", f == "truncated")
            whole.add(p.row(0, a))
        r = whole.row()
        assert (r["cost"], r["audit"]) == by_strings(rows)[:2]


def test_repaired_turns_read_well(spark):
    rows = many(4)
    turns = C.repair(C.damage(spark.createDataFrame(rows, SCHEMA))).collect()
    turns.sort(key=lambda r: (r["conv"] is None, r["conv"] or 0, r["turn"]))
    want = {c: by_strings(r)[2] for c, r in damaged(rows).items()}
    found = {c: tuple((r["role"], r["text"]) for r in g) for c, g in groupby(turns, key=lambda r: r["conv"])}
    assert all(PATTERN.fullmatch("".join(r[:1] for r, _ in g)) for g in found.values())
    assert found == {c: t for c, t in want.items() if t}


@pytest.mark.parametrize("mod", [None, 3])
def test_audits_compare_like_strings(monkeypatch, mod):
    if mod:
        monkeypatch.setattr(C, "_MOD", mod)
    rng, tree, text = random.Random(2), C.Audits(), [""]
    for _ in range(400):
        p = rng.randrange(len(text)) if rng.random() < 0.3 else len(text) - 1
        c = rng.choice("DIKR")
        assert tree.add(p, c) == len(text)
        text.append(text[p] + c)
    for _ in range(3000):
        a, b = rng.randrange(len(text)), rng.randrange(len(text))
        assert tree.less(a, b) == (text[a] < text[b]) and tree.text(a) == text[a]


def test_empty_and_clashing_tables(spark):
    clash = spark.createDataFrame([(*r, 1, 2, "x") for r in many(5, 8)], SCHEMA + ", conv int, copies int, digest string")
    assert got(C.repair_digests(C.damage(clash))) == plain([tuple(r)[:4] for r in clash.collect()])
    assert C.repair_digests(C.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = got(C.repair_digests(C.damage(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA))))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
