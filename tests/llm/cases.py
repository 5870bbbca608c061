"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = r"[^\x20\x09-\x0D]+"
SHARED = "\n".join(f"line {i} of the shared part" for i in range(16))
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today",
    "the QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf today",
    "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tomorrow",
    "Completely different words are written in this line of text about nothing at all",
    "one two",
    "one two",
    "one",
    "",
    None,
    " \n\t ",
    "é ü ß ñ",
    SHARED,
    "other start\n" + SHARED + "\nother end",
    "\n\n\n\n",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, row string, `key` long, kept boolean, score double"


def documents(spark, long_words: int = 30_000):
    """Ids from 1; id null once; one row twice; one id with two texts; one very long text and its copy."""
    rows = [(i + 1, t, ["en", "de", None][i % 3]) for i, t in enumerate(TEXTS)]
    long_text = " ".join(f"w{i * i % 7919}" for i in range(long_words))
    rows += [(100, long_text, "en"), (101, long_text, "de"), (3, TEXTS[2], "en"), (4, "another text under an id that repeats here", "en"), (None, TEXTS[0], "en")]
    return spark.createDataFrame([(i, t, g, None, None, 7, "x", 1, True, 0.5) for i, t, g in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
