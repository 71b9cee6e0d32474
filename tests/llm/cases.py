"""Small tables with the awkward rows that every operator must take, and helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of an input that clash with those of results.
CLASHING = ["score", "rank", "rid", "held_out", "kept", "key", "n", "component"]


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n, words="the of and ered thou shall ingre tion erst ble andre onin ther hence water stone river light"):
    words = words.split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(n=60, seed=5):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), f"src{i % 3}", None) for i in range(n)]
    rows += [(100, None, "en", None, None), (101, "", None, "a", 0), (102, " \t\n ", "en", "a", 3), (103, "!!! 123 ...", "en", "a", 3)]
    rows += [(104, rows[3][1], "en", "copy", 1), (104, rows[3][1], "en", "copy", 1), (None, rows[4][1], "en", "a", 1)]
    rows += [(105, prose(rng, 20_000), "en", "long", None), (106, "ÀÉ œuvre “q” Σας 漢字 <|endoftext|> don't", "fr", "odd", None)]
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def words_of(text, pattern):
    return re.findall(pattern, low(text))


def thue_morse(n):
    """Two different words of n letters, one the complement of the other: every polynomial hash modulo 2**64 takes them for one."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})
