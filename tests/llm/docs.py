"""Small documents for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, text outside ASCII."""
    long = " ".join(f"Word{i % 977}" for i in range(20_000))
    rows = [
        (1, "Alpha beta", "en", "a", 10), (2, "alpha BETA", "en", "b", 10), (3, "ÀLPHA", "fr", "a", 5), (4, "àLPHA", "fr", "a", 5),
        (5, None, None, None, None), (6, "", "en", "a", 0), (7, long, "en", "b", len(long)), (8, long.upper(), "en", "c", len(long)),
        (None, "no id", "en", "a", 5), (9, "x", None, "a", 1), (9, "x", None, "a", 1), (10, "12 34 !?", "de", "a", 8),
    ]
    return rows


def prose(n=60, seed=3, words=40):
    """Seeded prose with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(vocab) for _ in range(words)) for _ in range(3))
        if i % 7 == 3:
            text = rows[r.randrange(len(rows))][1]
        elif i % 7 == 4:
            parts = rows[r.randrange(len(rows))][1].split(" ")
            parts[r.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif i % 7 == 5:
            text = text[:80] + passage + "é" + text[80:]
        rows.append((i * 3 + 1, text, "en", f"s{i % 4}", len(text)))
    return rows
