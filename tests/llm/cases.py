"""Small tables with every awkward case: nulls, blanks, ties, copies, near copies, a long text."""

import random

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow of eternal silence at dawn".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randint(0, 60)) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace("fox", "cat", 1), "en", None),
        (4, None, None, "a"),
        (5, "", "de", "b"),
        (6, "  \n\t ", None, "b"),
        (7, "one", "de", "b"),
        (8, "Ünïcode Ärger ñandú 日本語 text", "de", "b"),
        (9, "\n\n".join([base] * 40), "en", "c"),
        (10, prose(2, 300), "en", "c"),
        (11, prose(3, 12) + " " + base[:150] + " " + prose(4, 9), "en", "c"),
        (None, prose(5, 30), "en", "c"),
        (None, None, "en", None),
        (13, prose(6, 40), "en", "a"),
        (13, prose(7, 40), "en", "a"),
        (14, prose(8, 25), "en", "a"),
        (14, prose(8, 25), "en", "a"),
        (15, "a  b \n c\r\nd e\x1cf <|endoftext|> it's 12!!", "en", "a"),
    ]
    return rows


DOCS = "doc_id long, text string, lang string, source string"
