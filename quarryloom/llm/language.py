"""Language identification in two levels: family first, then one-versus-one linear SVMs inside it.

A text's profile is the square root of the shares of its hashed byte 1-, 2- and
3-grams (UTF-8, lower case), scaled to length 1. Family: linear one-versus-rest
SVMs. Language: a linear SVM for each pair of languages of the family, by votes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh, returning_memory, slices, uniform

DIM = 2048
UNKNOWN = "und"
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: A letter, by Unicode's general category.
LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 20


def profile(text: str, dim: int = DIM) -> np.ndarray:
    """The whole text's profile; long texts are counted in blocks of bounded memory."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(dim, np.int64)
    for at in range(0, len(raw), _STEP):
        a = raw[max(0, at - 2) : at + _STEP].astype(np.uint32)
        fresh = min(at, 2)  # bytes repeated from the block before, for the grams that cross
        two = a[:-1] * np.uint32(257) + a[1:]
        three = two[:-1] * np.uint32(263) + a[2:]
        for grams, skip in ((a, fresh), (two, max(0, fresh - 1)), (three, 0)):
            counts += np.bincount((grams[skip:] * np.uint32(2654435761)) >> np.uint32(21) if dim == 2048 else (grams[skip:] * np.uint32(2654435761)) % np.uint32(dim), minlength=dim)
    total = counts.sum()
    return np.sqrt(counts / total, dtype=np.float32) if total else np.zeros(dim, np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and bias (last) for labels +-1: squared hinge, classes weighted evenly, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(xb.shape[1], np.float32)
    v = w.copy()
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ v)) * share
        new = v - 0.25 * (ridge * v - 2 * ((slack * y) @ xb))
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    families: list[str]
    members: list[list[str]]
    family_w: np.ndarray
    pair_w: list[dict[tuple[int, int], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores in (0, 1) for profiles by row."""
        xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = 3 * (xb @ self.family_w.T) if len(self.families) > 1 else np.zeros((len(x), 1))
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        langs = np.empty(len(x), object)
        score = p[np.arange(len(x)), best]
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            wins = np.zeros((len(rows), len(names)))
            sure = np.zeros((len(rows), len(names)))
            for (a, b), w in self.pair_w[f].items():
                q = 1 / (1 + np.exp(-3 * (xb[rows] @ w)))
                wins[:, a] += q >= 0.5
                wins[:, b] += q < 0.5
                sure[:, a] += q
                sure[:, b] += 1 - q
            pick = (wins + sure / (2 * len(names))).argmax(1)
            langs[rows] = np.array(names, object)[pick]
            if len(names) > 1:
                score[rows] *= sure[np.arange(len(rows)), pick] / (len(names) - 1)
        return list(langs), score


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    known = sorted(set(langs))
    families = sorted({FAMILY_OF.get(lang, f"only-{lang}") for lang in known})
    members = [[lang for lang in known if FAMILY_OF.get(lang, f"only-{lang}") == f] for f in families]
    of = np.array(langs, object)
    fam = np.array([FAMILY_OF.get(lang, f"only-{lang}") for lang in langs], object)
    family_w = np.stack([linear_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in families]) if len(families) > 1 else np.zeros((1, x.shape[1] + 1), np.float32)
    pairs: list[dict] = []
    for names in members:
        pairs.append({})
        for a, b in itertools.combinations(range(len(names)), 2):
            rows = (of == names[a]) | (of == names[b])
            pairs[-1][a, b] = linear_svm(x[rows], np.where(of[rows] == names[a], 1, -1).astype(np.float32))
    return LanguageModel(families, members, family_w, pairs)


def train(docs: DataFrame, may_learn: Column, per_language: int = 500, most_rows: int = 16_000) -> LanguageModel | None:
    """Fit on a sample: about ``per_language`` rows of each label, drawn by the hash of their id, or fewer of each where there are so many labels that all would be more than ``most_rows``.

    None if no row has a label. At most about ``most_rows`` profiles of 8 KB reach the driver.
    """
    labelled = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    labels = counts.count()
    if not labels:
        return None
    chance = F.lit(min(per_language, most_rows / labels)) / F.col("_n")
    sample = labelled.join(F.broadcast(counts), "lang").filter(uniform(F.col("doc_id"), F.lit("lang")) < chance).select("lang", "text")

    def profiles(batches):
        for b in batches:
            for part in slices(b, 1, 256):
                found = [profile(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["lang", "profile"])

    got = sorted(sample.mapInArrow(returning_memory(profiles), "lang string, profile binary").collect())
    if not got:
        return None
    return fit(np.stack([np.frombuffer(bytes(r[1]), np.float32) for r in got]), [r[0] for r in got])


def identify(docs: DataFrame, folds: int = 5, per_language: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs`` (doc_id, text, lang; other columns are not read).

    Learns from rows with a label whose crc32(doc_id) mod ``folds`` is not 0. A
    null text, or one without a letter, is ``und`` with score 0, and so is every
    text if nothing could be learned. Only the text decides a prediction, so rows
    that share an id, or have none, get their own each. Texts of any length are read whole, in
    blocks. Empty input gives an empty result.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out = fold(F.col("doc_id"), folds) == 0
    model = train(cols, ~held_out, per_language)
    return predicted(cols.select("doc_id", held_out.alias("held_out"), "text"), model, "told").select("doc_id", "held_out", "told.lang_pred", "told.score")


def predicted(docs: DataFrame, model: LanguageModel | None, name: str) -> DataFrame:
    """All columns of ``docs``, and ``name``: a struct of lang_pred and score of the row's own text, and whether that has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text, names = docs.columns.index("text"), [*docs.columns, name]

    def predict(batches):
        m = shared.value
        for b in batches:
            for part in slices(b, at_text):
                texts = part.column(at_text).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                lettered = [bool(t and LETTER.search(t)) for t in texts]
                if rows := [i for i, has in enumerate(lettered) if m and has]:
                    x = np.stack([profile(texts[i]) for i in rows])
                    for i, lang, s in zip(rows, *m.predict(x), strict=True):
                        langs[i], scores[i] = lang, s
                told = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(lettered, pa.bool_())], ["lang_pred", "score", "lettered"])
                yield pa.RecordBatch.from_arrays([*part.columns, told], names)

    told = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lettered", T.BooleanType())])
    return docs.mapInArrow(returning_memory(predict), T.StructType([*docs.schema.fields, T.StructField(name, told)]))


def documents_in_a_language(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose predicted language is wanted: any that could be learned, or one of ``languages``.

    Each row is judged by its own text alone. A null text or one without a letter is in no language and goes.
    Where nothing could be learned and no languages are named, every text with a letter
    stays. All columns are kept, whatever their names. Empty input gives an empty result.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(cols, fold(F.col("doc_id"), 5) != 0)
    told = fresh(docs, "_told")
    wanted = F.col(f"{told}.lang_pred").isin(languages) if languages else F.col(f"{told}.lang_pred") != UNKNOWN
    if model is None and not languages:
        wanted = F.col(f"{told}.lettered")
    return predicted(docs, model, told).filter(wanted).select(*docs.columns)
