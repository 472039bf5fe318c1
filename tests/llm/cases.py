"""Hand-made documents: nulls, empty and long texts, ties, repeated rows, further columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, tokens string, size long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "en", "b"),
    (3, None, "en", None), (4, "", None, "a"), (5, "   \n\t ", "fr", ""), (6, LONG, "en", "b"), (7, "one", None, None),
    (8, "one two three", "de", "a"), (9, "One two  THREE", "de", "c"), (10, "12 34 !! ??", None, "c"),
    (11, "même texte été où ça 漢字 かな <|endoftext|> it's we'll x y", "fr", "a"), (11, "même texte été où ça 漢字 かな <|endoftext|> it's we'll x y", "fr", "a"),
    (12, "a" * 20_000, None, "b"), (None, "a row without an id but with quite a few words in it", "en", "a"),
    (13, "Released under the GNU General Public Licence; see also Apache License and CC-BY, cc by.", "en", "c"),
    (14, "mail jo.doe@example.com or call +1 (359) 555-5478, card 4089568897667582, born 1990-02-28 at 10.20.30.40", "en", "a"),
]
ROWS = [(d, t, lang, source, None if t is None else len(t), "k", 7, "t", 5) for d, t, lang, source in TEXTS]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
