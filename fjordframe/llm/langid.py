"""Language identification by rank-order profiles.

A language's profile ranks its most frequent n-grams, one to four bytes of lower-cased words with a space on either
side, counted over all its training texts. A document's own ranking is compared by out-of-place distance: each of its
first PROFILE n-grams costs the difference between its two ranks, or PROFILE where the language lacks it. The
least distance wins, ties by name. The score is one less the distance's share of the largest possible one.

A null text, or one without a letter, is `und` with score 0, as is every text where nothing was learned. Texts with
a null language, and rows with a null id, are judged but not learned from (a null id is in no fold). Rows that repeat
count, and come back, each. Other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.llm.common import mapped, text_column
from fjordframe.llm.textbytes import joined_words, owners, pieces, summed

PROFILE, LONGEST, SALT = 300, 4, 16
UNKNOWN = "und"
#: Texts that one sort takes together; their number has 12 bits in the sort key.
_TEXTS = 4096
#: Places whose n-grams are in memory at once, whatever the length of a text.
_STRETCH = 1 << 18

_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


class _Stream:
    """The words of every text in a row, parted by single spaces, with one before the first and after the last."""

    def __init__(self, texts: pa.Array):
        out, bounds = joined_words(texts, _LETTERS)
        lead = np.flatnonzero(out[:-1] == 0xC3)
        upper = lead[(out[lead + 1] >= 0x80) & (out[lead + 1] <= 0x9E) & (out[lead + 1] != 0x97)]
        out[upper + 1] += 32
        some = np.diff(bounds) > 0
        self.has_letter = np.zeros(len(some), bool)
        if some.any():
            self.has_letter[some] = np.logical_or.reduceat((out >= 0x61) & (out <= 0x7A), bounds[:-1][some])
        self.data = np.insert(out, bounds[:-1][some], 0x20)
        self.bounds = bounds + np.concatenate([[0], np.cumsum(some)])

    def grams(self) -> Iterator[np.ndarray]:
        """(text << 32 | n-gram) of every n-gram, by stretches of the places where they end."""
        for a in range(0, len(self.data), _STRETCH):
            b = min(len(self.data), a + _STRETCH)
            back = min(a, LONGEST - 1)
            x = self.data[a - back : b].astype(np.uint64)
            of = owners(self.bounds, a - back, b).astype(np.uint64)
            gram, found = x, []
            for k in range(1, LONGEST + 1):
                if k > 1:
                    gram = gram[:-1] << np.uint64(8) | x[k - 1 :]
                ends = of[k - 1 :]
                wanted = ends == of[: len(ends)]
                wanted[: max(0, back - k + 1)] = False
                if k == 1:
                    wanted &= x != 0x20
                found.append((ends << np.uint64(32) | gram)[wanted])
            yield np.concatenate(found)


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, whole.num_rows, _TEXTS):
        yield from pieces(whole.slice(at, _TEXTS), "text", 1 << 18)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's training texts."""
    for whole in batches:
        for b in _slices(whole):
            langs = b["lang"].dictionary_encode()
            own = langs.indices.to_numpy().astype(np.uint64)
            for grams in _Stream(b["text"]).grams():
                lang = own[(grams >> np.uint64(32)).astype(np.int64)]
                keys, n = np.unique(lang << np.uint64(32) | grams & np.uint64(0xFFFFFFFF), return_counts=True)
                names = langs.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def language_profiles(docs: DataFrame, training: Column) -> DataFrame:
    """(lang, gram, place): the first PROFILE n-grams of every language in the training texts."""
    texts = docs.where(training).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = texts.transform(mapped, _learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language's n-grams are first cut down in SALT parts, so that no task takes all of one language's.
    order = [F.desc("n"), F.col("gram")]
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = counts.withColumn("part", F.pmod(F.hash("gram"), F.lit(SALT))).withColumn("place", part).where(F.col("place") <= PROFILE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return few.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "gram", "place")


class Profiles:
    """Ranks of n-grams by language."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, place: np.ndarray):
        self.names, of = np.unique(lang.astype(str), return_inverse=True)
        self.grams, at = np.unique(gram, return_inverse=True)
        self.places = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        self.places[at, of] = place - 1

    def judge(self, texts: pa.Array, declared: list | None = None) -> tuple[list[str], np.ndarray, list]:
        """Each text's language and score, and the score of its declared language; null if that is none or was not learned."""
        n = len(texts)
        stream = _Stream(texts)
        has_letter = stream.has_letter
        for r in np.flatnonzero(~has_letter):
            has_letter[r] = any(map(str.isalpha, texts[int(r)].as_py() or ""))
        names, scores = [UNKNOWN] * n, np.zeros(n)
        if not len(self.names):
            return names, scores, [None] * n
        parts = [np.unique(grams, return_counts=True) for grams in stream.grams()]
        keys, counts = summed(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # By row and falling count; grams of one count stay in their order. A slice has few rows, and no text 2**52 bytes.
        row = (keys >> np.uint64(32)).astype(np.int64)
        order = np.argsort(row << 52 | (1 << 52) - 1 - counts, kind="stable")
        keys, row = keys[order], row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < PROFILE
        row, rank, gram = row[keep], rank[keep], (keys[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        places = self.places[at]
        cost = np.where(places < 0, PROFILE, np.abs(places - rank[:, None]))
        rows, first = np.unique(row, return_index=True)
        distance = np.full((n, len(self.names)), 1.0)
        if len(rows):
            distance[rows] = np.add.reduceat(cost, first) / (PROFILE * np.diff(np.append(first, len(row)))[:, None])
        best = distance.argmin(axis=1)
        for r in np.flatnonzero(has_letter):
            names[r], scores[r] = str(self.names[best[r]]), 1 - distance[r, best[r]]
        place = {str(name): k for k, name in enumerate(self.names)}
        own = [place.get(d) for d in declared or [None] * n]
        return names, scores, [None if k is None or not has_letter[r] else float(1 - distance[r, k]) for r, k in enumerate(own)]


def identify(docs: DataFrame, profiles: DataFrame, columns: tuple[str, str] = ("lang_pred", "score"), declared: tuple[str, str] | None = None) -> DataFrame:
    """docs with the language and its score added, under names that docs does not have; docs must have a text column.

    declared, if given, names a column with a language, and a new one for that language's score; it is no input of the rest.
    """
    p = profiles.toArrow()  # PROFILE rows a language
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(p["lang"].to_numpy(zero_copy_only=False), p["gram"].to_numpy(), p["place"].to_numpy()))
    more = [*columns, *(declared or ())[1:]]

    def judge(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *own in arrays:
            whole = pa.RecordBatch.from_arrays([text, *own], names=["text", *(["declared"] if own else [])])
            found = [shared.value.judge(b["text"], b["declared"].to_pylist() if own else None) for b in _slices(whole)]
            each = [pa.array([x for f in found for x in f[k]], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64())[: len(more)])]
            yield pa.StructArray.from_arrays(each, names=["a", "b", "c"][: len(more)])

    judged = text_column(docs.sparkSession, judge, f"a string, b double{', c double' if declared else ''}", "text", *(declared or ())[:1])
    held = "_fjordframe_judged"
    return docs.withColumn(held, judged).withColumns({name: F.col(f"{held}.{k}") for name, k in zip(more, "abc")}).drop(held)  # noqa: B905
