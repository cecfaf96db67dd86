"""Preference pairs against a plain version, turn by turn."""

import random
from collections import defaultdict

from cinderlog.llm import preference

CONVERSATION = "pair_id long, turn long, role string, text string"


def plain(chosen, rejected):
    """All result rows, one pair after another."""
    sides = defaultdict(lambda: ([], []))
    for at, rows in enumerate((chosen, rejected)):
        for pair, turn, role, text in {(p, t, r or "", x or "") for p, t, r, x in rows}:
            sides[pair][at].append((turn is not None, turn or 0, role, text))
    out = set()
    for pair, (a, b) in sides.items():
        a, b = ([row[2:] for row in sorted(side)] for side in (a, b))
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        for part, turns, first in (("prompt", a[:same], 0), ("chosen", a[same:], same), ("rejected", b[same:], same)):
            start = 0
            for i, (role, text) in enumerate(turns):
                head, body = f"<|im_start|>{role}\n", f"{text}<|im_end|>\n"
                learned = part != "prompt" and role == "assistant"
                span = (start + len(head), len(body)) if learned else (start, 0)
                out.add((pair, part, first + i, role, head + body, start, len(head + body), *span))
                start += len(head + body)
    return out


def both(spark, chosen, rejected):
    got = [tuple(r) for r in preference.format_pairs(spark.createDataFrame(chosen, CONVERSATION), spark.createDataFrame(rejected, CONVERSATION)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(chosen, rejected)
    return got


def test_pairs_against_a_plain_version(spark):
    draw = random.Random(7)
    chosen, rejected = [], []
    for pair in range(40):
        for side in (chosen, rejected):
            for turn in range(draw.randint(0, 6)):
                text = draw.choice(["yes", "yes", "yes", "no é𝄞", "", None])
                side += [(pair, turn * 3, draw.choice(["user", "user", "assistant", None]), text)] * draw.choice([1, 1, 2])
    both(spark, chosen, rejected)


def test_long_conversation_crosses_blocks(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    other = turns[:2500] + [(1, t, r, "else " + x) for _, t, r, x in turns[2500:]]
    got = both(spark, turns, other)
    assert sum(r[1] == "prompt" for r in got) == 2500


def test_odd_pairs(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, None, "user", "x"), (2, 5, "assistant", "y"), (None, 0, "user", "z"),
              (4, 0, "user", "tie b"), (4, 0, "user", "tie a"), (5, 0, "user", "<|im_end|>"), (5, 1, "assistant", "long " * 100_000)]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, None, "user", "x"), (3, 0, "assistant", "alone"), (None, 0, "user", "z"),
                (4, 0, "user", "tie a"), (4, 0, "user", "tie b"), (5, 0, "user", "<|im_end|>"), (5, 1, "assistant", "")]
    got = both(spark, chosen, rejected)
    assert {r[1] for r in got if r[0] == 1} == {"prompt"} and {r[1] for r in got if r[0] == 3} == {"rejected"}
    assert {r[1] for r in got if r[0] is None} == {"prompt"} and {r[1] for r in got if r[0] == 4} == {"prompt"}
    assert both(spark, [], []) == []


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "a\nb", 3, 4)], CONVERSATION + ", position long, _block long")
    got = preference.format_pairs(rows, preference.lines_reversed(rows)).collect()
    assert {(r.part, r.rendered) for r in got} == {("chosen", "<|im_start|>assistant\na\nb<|im_end|>\n"), ("rejected", "<|im_start|>assistant\nb\na<|im_end|>\n")}
