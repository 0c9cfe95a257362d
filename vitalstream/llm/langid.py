"""Language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent letter n-grams (one to three
letters, words padded) in order of frequency, ties by the n-gram. A text's
profile is compared to each language's by the out-of-place distance: the sum of
how far each n-gram is from its place in the language's profile, ``PROFILE``
where it is not in it. The nearest language wins, ties by name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalstream.llm.common import col, kept_rows, pieces_of, rows_of

PROFILE, MAX_LANGUAGES = 300, 2000
UNDETERMINED = "und"
OTHER = re.compile(r"[\W\d_]+")
STRIDE = 1 << 20
GAP = np.uint64(ord("_"))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, as 21 bits a letter, and their counts."""
    text, codes, counts, at = text or "", [], [], 0
    while at < len(text):
        end = min(len(text), at + STRIDE)
        while end < len(text) and not text[end].isspace():
            end += 1
        letters = "_" + OTHER.sub("_", text[at:end].lower()).strip("_") + "_"
        at = end
        if len(letters) > 2:
            found = np.unique(_codes(letters), return_counts=True)
            codes.append(found[0])
            counts.append(found[1])
    if len(codes) == 1:
        return codes[0], counts[0]
    return _summed(codes, counts)


def _codes(letters: str) -> np.ndarray:
    one = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    two = (one[:-1] << np.uint64(21)) | one[1:]
    three = (two[:-1] << np.uint64(21)) | one[2:]
    return np.concatenate([one[one != GAP], two, three[one[1:-1] != GAP]])


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def fit_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang``, ``gram``, ``place`` (from 0): the profile of every language, over all rows with a language.

    Every task sums its rows up before the shuffle, so a language with most of
    the rows is a few thousand counts per task. Null languages and texts
    without letters add nothing.
    """
    rows = df.where(col(lang).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                found = [grams(t) for t in part.column("text").to_pylist()]
                for name in sorted(set(langs)):
                    own = [found[i] for i in np.flatnonzero(langs == name)]
                    codes, counts = _summed(*zip(*own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                        ["lang", "gram", "n"],
                    )

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """Profiles of all languages as one table of places; ``size`` entries per language at most."""

    def __init__(self, rows: pd.DataFrame, size: int = PROFILE):
        self.size = size
        self.langs = sorted(rows["lang"].unique())
        self.grams = np.unique(rows["gram"].to_numpy(np.int64).view(np.uint64))
        self.places = np.full((len(self.langs), len(self.grams) + 1), size, np.int32)
        at = np.searchsorted(self.grams, rows["gram"].to_numpy(np.int64).view(np.uint64))
        self.places[np.searchsorted(np.array(self.langs, dtype=object), rows["lang"].to_numpy(object)), at] = rows["place"]

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        top = codes[np.lexsort((codes, -counts))[: self.size]]
        at = np.searchsorted(self.grams, top)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == top[known]
        at[~known] = len(self.grams)
        places = self.places[:, at]
        apart = np.where(places < self.size, np.abs(places - np.arange(len(top))), self.size).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(top)))


def load_profiles(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    """To the driver: ``size`` rows per language, and no more than ``MAX_LANGUAGES`` languages."""
    rows = profiles.limit(size * MAX_LANGUAGES + 1).toPandas()
    if len(rows) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles(rows, size)


def predicted(text: Column, profiles: Profiles) -> Column:
    """A struct (``lang_pred``, ``score``) for each whole text: ``und`` and 0 for null, empty or letterless texts.

    ``score`` is one minus the distance over the greatest possible distance.
    """

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.nearest(t) for t in texts], columns=["lang_pred", "score"])

    return identify(text)


def in_learning(doc_id: Column) -> Column:
    """Whether a row's label may be learned from; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def identify_languages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``; profiles are learned from the rest.

    Repeated rows count as often as they stand. Without any labelled row every
    prediction is ``und``. Rows with a null id are neither held out nor learned from.
    """
    profiles = load_profiles(fit_profiles(df.where(in_learning(col(doc_id))), text, lang))
    found = predicted(col(text).cast("string"), profiles)
    held_out = F.coalesce(F.crc32(col(doc_id).cast("string")) % 3 == 1, F.lit(False))
    return df.select(col(doc_id).alias("doc_id"), held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def drop_undetermined(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", least: float = 0.0
) -> DataFrame:
    """The rows of ``df`` whose text has letters and whose language has a score of ``least`` or more; all columns stay as they are.

    With the default only null, empty and letterless texts go. Without any labelled text there
    is no profile and no score, and every text with letters stays.
    """
    fields = df.columns
    profiles = load_profiles(fit_profiles(df.where(in_learning(col(doc_id))), text, lang))
    if not profiles.langs:
        return kept_rows(rows_of(df, lettered=lettered(col(text).cast("string"))).where("lettered"), fields)
    rows = rows_of(df, found=predicted(col(text).cast("string"), profiles))
    return kept_rows(rows.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least)), fields)


def lettered(text: Column) -> Column:
    """Whether a text has a letter."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: OTHER.sub("", t or "") != "").astype(bool)

    return found(text)
