"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent letter n-grams (lengths 1 to 3, words padded by a space on either side) by falling
count, ties by code points. A document's profile is compared to each language's: every n-gram adds the difference of
its two ranks, or the profile's length if the language has it not; the language nearest in all is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, chunks

PROFILE = 300
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20
HELD_GRAMS = 500_000
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _TABLE:
        _TABLE.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _TABLE[0]


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text's words, ascending, and their counts.

    An n-gram is its code points in 21 bits apiece, the first one highest. Words are runs of letters of the lower-cased
    text, each with a space on either side; no n-gram reaches over a space. Long texts are taken in pieces, of which each
    begins with the last two places of the one before.
    """
    text = text.lower()
    found = None
    carry, after_letter = np.array([32]), False
    for at in range(0, len(text) or 1, CHUNK_CHARS):
        c = np.frombuffer(text[at : at + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if after_letter and len(keep):
            keep[0] = True
        after_letter = bool(len(letter) and letter[-1])
        end = [32] if at + CHUNK_CHARS >= len(text) else []
        s = np.concatenate((carry, np.where(letter, c, 32)[keep], end)).astype(np.int64)
        old = len(carry)
        word = s != 32
        two = s[:-1] << 42 | s[1:] << 21
        three = two[:-1] | s[2:]
        fresh = max(0, old - 2)
        grams = np.concatenate(((s << 42)[old:][word[old:]], two[old - 1 :][(word[:-1] | word[1:])[old - 1 :]], three[fresh:][word[1:-1][fresh:]]))
        grams.sort()
        cut = np.flatnonzero(np.concatenate((grams[:1] >= 0, grams[1:] != grams[:-1])))
        got = grams[cut], np.diff(np.append(cut, len(grams)))
        found = got if found is None else add_counts(found, got)
        carry = s[-2:]
    return found


def add_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, weights = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    cut = np.flatnonzero(np.concatenate((grams[:1] >= 0, grams[1:] != grams[:-1])))
    return grams[cut], np.add.reduceat(weights[order], cut) if len(cut) else weights


def spell(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0) if gram >> s & 0x1FFFFF)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code points."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # of all languages, ascending
    ranks: np.ndarray  # of each of them in each language; the last row is for n-grams that none has
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From (language, n-gram, rank from 0)."""
        languages = sorted({r[0] for r in rows})
        grams = np.array(sorted({r[1] for r in rows}), np.int64)
        ranks = np.full((len(grams) + 1, len(languages)), -1, np.int64)
        for language, gram, rank in rows:
            ranks[np.searchsorted(grams, gram), languages.index(language)] = rank
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance over the largest possible one."""
        grams, counts = count_grams(text or "")
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        k = int(np.argmin(far))
        return self.languages[k], 1 - float(far[k]) / (self.size * len(own))


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of every non-null ``lang`` from all its texts in ``labelled(text, lang)``.

    N-grams are counted in each task and the counts summed in one shuffle; only the profiles,
    ``size`` rows a language, come to the driver. Null texts and texts without letters add nothing.
    """
    bound_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for part in chunks([len(t) for t in own], CHUNK_CHARS):
                    got = count_grams(" ".join(own[part]))
                    held[lang] = add_counts(held[lang], got) if lang in held else got
            if sum(len(g) for g, _ in held.values()) >= HELD_GRAMS:
                yield from flush()
        yield from flush()

    counts = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    top = counts.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= size)
    best = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= size)
    return Profiles.of([(r.lang, r.gram, r.r - 1) for r in best.select("lang", "gram", "r").collect()], size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text when there are no profiles.
    Equal distances go to the language that sorts first. Repeated rows are predicted alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(folds: int, fold: int):
    """Whether crc32 of the doc_id as text falls into a fold; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def predict_held_out(docs: DataFrame, folds: int = 4, fold: int = 2, size: int = PROFILE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, by profiles learnt from the rows not held out."""
    profiles = learn_profiles(docs.filter(~held_out(folds, fold)).select("text", "lang"), size)
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out(folds, fold).alias("held_out"), "lang_pred", "score")
