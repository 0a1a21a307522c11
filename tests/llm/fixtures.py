"""Invented prose for the tests."""

WORDS = [a + b + c for a in ("ba", "ko", "mi", "tu", "re", "sa") for b in ("lo", "ni", "pe", "ra") for c in ("n", "st", "ka", "")]
ITEM = "what river runs through the old city of lorim and its seven hills? the broad river tamen runs there always"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))
