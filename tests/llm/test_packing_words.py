"""Words are put together from their runs, slice by slice."""

import random

import public_tokenizers

from cinderlog.llm.packing import Encoder

SPEC = open(public_tokenizers.path("word_bpe_49k.json")).read()


def test_ids_are_the_library_s():
    machine, pick = Encoder(SPEC), random.Random(1)
    signs = "aZéÀßÿ×÷'<>09,.-_~ \t\n\x0b\x1c\x00\x7f İıſΣς日\U0001f600éÃã\x80"
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 40))) for _ in range(800)]
    texts += ["", "  ", " a", "Straße ÉCOLE", "x" * 70 + " " + "é" * 80, "don't <s> </s> <unk>"]
    for part in (texts, [], [""], ["'"], ["a"]):
        values, counts = machine.ids(part)
        want = [e.ids for e in machine.library.encode_batch(part, add_special_tokens=False)] if part else []
        assert counts.tolist() == [len(w) for w in want]
        assert values.tolist() == [i for w in want for i in w]


def test_a_worker_remembers_runs_and_not_words():
    machine = Encoder(SPEC)
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    machine.ids([" ".join(f"{x}-{y}" for x in names for y in names)])  # 10 000 different words of 101 runs
    held = sum(len(v) for v in vars(machine).values() if isinstance(v, dict))
    assert held == len(names) + 1
