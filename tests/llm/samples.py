"""Small documents for the tests of the corpus operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def row(number, text, lang="en", source="s0"):
    return (number, text, lang, source, None if text is None else len(text))


WORDS = (
    "river stone window garden letter morning station market winter bridge paper mountain village silver kitchen "
    "harbour lantern shoulder valley machine orchard captain whisper feather copper thunder meadow saddle pepper anchor"
).split()


def prose(seed, words, offset=0):
    """Invented sentences of nine words each, all different for different seeds."""
    made = []
    for i in range(words):
        stem = WORDS[(i * 7 + seed * 3) % len(WORDS)] + WORDS[(i * 11 + seed * 5 + 1) % len(WORDS)][:3] + chr(97 + (i * i + seed) % 26)
        made.append((stem.capitalize() if i % 9 == 0 else stem) + ("." if i % 9 == 8 or i == words - 1 else ""))
    return " ".join(made)
