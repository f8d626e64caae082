from __future__ import annotations

import random

import pytest

EXTRA = "n_words long, kept string, size string, h int, label string, s string, node int, spans string, bin string, row int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    lines, words = [], []
    for _ in range(n):
        words.append("w" + format(rng.randrange(vocabulary), "x") + rng.choice(["", "", "ä", "."]))
        if rng.random() < 0.08:
            lines.append(" ".join(words))
            words = []
    return "\n".join([*lines, " ".join(words)])


def changed(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(9999)}" if rng.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    """Documents with everything that may go wrong: (doc_id, text, lang, source)."""
    base, other = prose(1, 300), prose(2, 260)
    passage = prose(3, 60)
    texts = [
        base, base, changed(base, 1, 0.03), changed(base, 2, 0.05), changed(base, 3, 0.2), other, other.upper(), "", None, " \n\t ", "one",
        "One", "two words", "a a a a a a", "the the the " * 40, passage + " " + prose(4, 90), prose(5, 90) + "\n" + passage, "é" * 150 + "ü" * 150,
        "x" * 700, "x" * 250, "y\x00z \x1f\x0b\x0c     end", "<|endoftext|> and more", prose(6, 9000), "#*$%&|<>! " * 80,
        "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "cc by cc by 4.0", "line\nline\nline\nother",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", None, "src2")[i % 4]) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(50 + i, 120), "en", "src0") for i in range(40)]
    rows += [(3, texts[3], None, "src2"), (None, base, "en", "src0"), (None, None, None, None), (None, prose(9, 80), "en", "src1")]
    return rows


def frame(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), 7, "k", "z", 1, "l", "s", 2, "sp", "b", 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
