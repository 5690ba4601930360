import re


def ascii_words(text):
    """Words of A-Z lower-cased text, split at ASCII white space."""
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


LONG = "Long words go on and on; é ü. " * 6_000
#: Null in each column, empty, blank and very long texts, repeated rows, ties, columns whose names operators use themselves.
ROWS = [
    (1, "Under the MIT license: some plain words stand here for all to read.", "en", "a", 1, 1, "x", 1),
    (2, None, "en", "a", 2, 1, "x", 1),
    (3, "", None, "b", 3, 1, "x", 1),
    (4, " \n\t ", "de", None, 4, 1, "x", 1),
    (5, "under the mit LICENSE: some plain words stand here for all to read.", "en", "b", 5, 1, None, None),
    (6, "twice", "en", "a", 6, 1, "x", 1),
    (6, "twice", "en", "a", 6, 1, "x", 1),
    (None, "Under the MIT license: some plain words stand here for all to read.", None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None),
    (7, LONG, "fr", "c", len(LONG), 1, "x", 1),
    (8, "Ünïcode \U0001f600 ź ﬁ   <|endoftext|> İstanbul", "tr", "c", 9, 1, "x", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, rank long"


def edge_documents(spark):
    extra = ", _words string, uid string, n long, _id long, _kept long, _copies long, _copy long, range long, place long, h long, s string, r long"
    rows = [(*r, "w", "u", 0, 0, 0, 0, 0, 0, 0, 0, "s", 0) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + extra).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
