from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, score double"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns, some of which clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "x", 0.5) for i, t, lang, s in rows], SCHEMA)


ODD = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \n\t ", "en", "a"),
    (None, "a text without an id, of a few words", None, "b"),
    (4, "the same text of ten words that is told twice over", "en", "a"),
    (5, "the same text of ten words that is told twice over", "en", "c"),
    (5, "the same text of ten words that is told twice over", "en", "c"),
    (6, "wort " * 3000 + "ende", "de", "a"),
    (7, "one two", "en", None),
    (8, "ünï¢ødé 日本語 😀 text\x00 with\x1codd ​ characters", None, "b"),
]
