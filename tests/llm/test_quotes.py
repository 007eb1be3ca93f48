from __future__ import annotations

import random
import re

import pytest

from quire.llm import quotes as Q

TALK = [
    (1, 0, "user", "How do I open the file?\nIt has no name."),
    (1, 1, "assistant", "> How do I open the FILE?\nWith a hammer."),
    (1, 2, "user", "Something else."),
    (1, 3, "user", "On Monday, the assistant wrote:\n> > How do I open the file?\n> With a hammer.\n\nThat broke it."),
    (1, 4, "user", ">How do I open the file?\n> Unknown\nStill open?"),
    (2, 0, "user", "> With a hammer.\nA quote of another conversation"),
    (2, None, "user", "> A quote of another conversation\nlate"),
    (3, 0, "user", None),
    (3, 1, "assistant", ""),
    (3, 1, "assistant", ""),
    (None, 0, "user", "> x\ny"),
    (None, 1, "user", "y"),
    (4, 0, "user", "line\r\n" * 20000),
    (5, 0, "user", "Thanks.\nThe red boat leaves\nthe harbour at nine o'clock every single morning."),
    (5, 1, "user", "Thanks.\nNo boat here."),
    (5, 2, "user", "> Thanks. The red boat\n> leaves the harbour\n> at nine o'clock every single\n> morning.\nWhen does it return?"),
    (5, 3, "user", "> Thanks.\nYou are welcome."),
    (6, 0, "user", "Alpha beta.\n\nGamma delta epsilon zeta eta theta iota."),
    (6, 1, "user", "no"),
    (6, 2, "user", "> quite different text that nobody wrote before\n> Thanks.\nhm"),
]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "2 as parent", "'h' as hash", "3 as position").repartition(3)
    return Q.reply_order(df, **more).collect()


@pytest.mark.parametrize("most", [1, 1000])
def test_replies(spark, most):
    got = run(spark, TALK, most=most, stretch=2)
    assert len(got) == len(TALK)
    talk = lambda c: {r.turn: (r.reply_to, r.position, r.depth, r.n_quoted, r.n_linked, r.text) for r in got if r.conv_id == c}
    assert talk(1) == {
        0: (None, 0, 0, 0, 0, "How do I open the file?\nIt has no name."),
        1: (0, 1, 1, 1, 1, "With a hammer."),
        2: (1, 2, 2, 0, 0, "Something else."),
        3: (1, 3, 2, 2, 2, "That broke it."),
        4: (0, 4, 1, 1, 1, "Still open?"),
    }
    assert {t: x[:2] + x[3:] for t, x in talk(2).items()} == {0: (None, 0, 1, 0, "A quote of another conversation"), None: (0, 1, 1, 0, "late")}
    assert sorted((r.turn, r.position, r.text) for r in got if r.conv_id == 3) == [(0, 0, ""), (1, 1, ""), (1, 2, "")]
    assert sorted((r.text, r.position, r.reply_to, r.n_linked) for r in got if r.conv_id is None) == [("y", 0, None, 0)] * 2
    # wrapped anew, and with a line that a later message has too
    assert {t: (x[0], x[4]) for t, x in talk(5).items()} == {0: (None, 0), 1: (0, 0), 2: (0, 1), 3: (1, 1)}
    # one common line in a passage of others is no link
    assert talk(6)[2][0] == 1 and talk(6)[2][3:5] == (1, 0)


def test_passages_and_pieces():
    assert Q.passages("On Monday, Al wrote:\n> > deep\n>> more\n> one\nown\r\nthing") == [(2, "deep\nmore"), (1, "one"), (0, "own\nthing")]
    words, found = Q.pieces("One two. Three\nfour\n\nfive_six seven")
    assert words == ["one", "two", "three", "four", "five", "six", "seven"]
    assert {(a, n) for kind, a, n in found if kind} == {(0, 7), (0, 2), (2, 2), (0, 3), (3, 1), (0, 4), (4, 3)}
    assert [(a, n) for kind, a, n in found if not kind] == [(0, 5), (1, 5), (2, 5)]


def _split(text):
    out = []
    for line in text.split("\n"):
        m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
        level = m[1].count(">") if m else 0
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line[m.end() :] if m else line)
    return [(level, "\n".join(rows)) for level, rows in out]


def brute(rows):
    """(turn, text) of one conversation by turn: reply_to, position, depth, n_quoted, n_linked, compared word by word."""
    own = []
    for turn, text in rows:
        offers = set()
        for level, body in _split(text):
            if not level:
                words, found = Q.pieces(body)
                offers |= {(kind, *words[a : a + n]) for kind, a, n in found}
        own.append((turn, offers))
    parents, counts = {}, {}
    for k, (turn, text) in enumerate(rows):
        quoted = linked = 0
        votes = {}
        for level, body in _split(text):
            if not level:
                continue
            quoted += 1
            words, found = Q.pieces(body)
            cover = {}
            for kind, a, n in found:
                piece = (kind, *words[a : a + n])
                last = max((i for i, (t, o) in enumerate(own) if t < turn and piece in o), default=None)
                if last is not None:
                    cover.setdefault(last, set()).update(range(a, a + n))
            good = {i: len(c) for i, c in cover.items() if 2 * len(c) >= len(words)}
            linked += bool(good)
            for i, c in good.items():
                votes[level, i] = votes.get((level, i), 0) + c
        parents[k] = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else k - 1
        counts[k] = (quoted, linked)
    place, out = 0, {}

    def visit(k, depth):
        nonlocal place
        out[rows[k][0]] = (rows[parents[k]][0] if k else None, place, depth, *counts[k])
        place += 1
        for c in range(k + 1, len(rows)):
            if parents[c] == k:
                visit(c, depth + 1)

    visit(0, 0)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = ["Thanks.", "I see what you mean there.", "ok"]
    said, rows = [], []
    for turn in range(n):
        text = []
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if not said:
                continue
            words = rng.choice(said).split()
            a = rng.randrange(len(words))
            part = words[a : a + rng.randint(1, 14)] if rng.random() < 0.6 else words
            if rng.random() < 0.3:
                part = [*part[:3], "changed", *part[4:]]
            width, level = rng.randint(2, 8), rng.choice(["> ", "> ", ">> ", "> > "])
            text += [level + " ".join(part[i : i + width]) for i in range(0, len(part), width)]
            if rng.random() < 0.3:
                text.append("> " + rng.choice(common))
        mine = [" ".join(rng.choice(vocabulary) + (".", "", "")[rng.randrange(3)] for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.4:
            mine.append(rng.choice(common))
        if rng.random() < 0.2:
            mine.insert(0, "")
        said += [" ".join(mine)] if "".join(mine).strip() else []
        rows.append((turn * 2, "\n".join(text + mine)))
    return rows


@pytest.mark.parametrize("most", [5, 1000])
def test_against_brute_force(spark, most):
    talks = {c: corpus(c, 70 if c == 0 else 12) for c in range(6)}
    got = run(spark, [(c, t, "user", x) for c, rows in talks.items() for t, x in rows], most=most, stretch=8)
    for c, rows in talks.items():
        assert {r.turn: (r.reply_to, r.position, r.depth, r.n_quoted, r.n_linked) for r in got if r.conv_id == c} == brute(rows)
    assert sum(r.n_linked for r in got) > 50


def test_no_rows(spark):
    assert Q.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
