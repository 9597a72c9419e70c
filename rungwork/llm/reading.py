"""Problem 10: reading level of each document, by regularised ordinal regression on graded text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.session import materialize, spread, table

BANDS = 5
#: Fewest words of a document that gets a level.
LEAST_WORDS = 60
#: Labelled documents the regression is fitted on, taken by hash if there are more.
MOST_LABELLED = 20_000
#: Most graders who get an offset of their own.
MOST_GRADERS = 200
#: A word is counted as known if it holds this share of all words, so at most 1 / KNOWN_SHARE are known.
KNOWN_SHARE = 1e-6
RIDGE = 1.0

#: Common words of languages, by which a text is told to be English.
ENGLISH = "the of and to in a is was that it for on with as by at were had we they my her his from but or not this be are which i you".split()
OTHERS = "el la los las de que y en un una por con no se del al lo su para es der die das und ist nicht ein eine mit von zu den dem im war auf für wir ich sie le les des du et est pas une dans il pour sur qui que di che non il per sono della um não uma os do da het een van niet ik".split()
#: Words that join clauses, and words that begin dependent ones.
CONNECTIVES = "although because whereas nevertheless notwithstanding moreover furthermore therefore thus hence consequently however nonetheless thereby accordingly yet conversely likewise otherwise insofar contrast then so".split()
SUBORDINATORS = "which that whose whom who when while if since because although whereas until before after once whether unless where what how than having".split()
PRONOUNS = "i we my me he she they our your you his her him them us it".split()

FEATURES = ("rarity", "rare_share", "word_length", "long_share", "very_long_share", "diversity", "connectives", "subordination", "pronouns", "commas", "log_words", "rarity_spread", "length_spread", "rarity_top")

_TAG = re.compile(r"<[^<>]{0,300}>|&#?\w{1,8};")
_PARTED = re.compile(r"(?<=\w)-[ \t]*\n\s*(?=\w)")
_LINE = re.compile(r"(?m)^\s*(?:page \d+(?: of \d+)?|[A-Z]{1,3}:)\s?", re.IGNORECASE)
#: Everything but letters and apostrophes parts words.
_PARTS = {c: " " for c in [*range(128), *map(ord, "“”‘«»‹›–—…¿¡·•§°\u00a0\u2002\u2003\u2009")] if not (chr(c).isalpha() or chr(c) == "'")}


def plain(text: str) -> str:
    """A text in lower case without markup, page marks, speaker labels and hyphens at line ends."""
    return _LINE.sub(" ", _PARTED.sub("", _TAG.sub(" ", text))).lower()


def words(low: str) -> list[str]:
    """Words of a text in lower case."""
    return low.translate(_PARTS).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents, summed up in each partition before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for df in batches:
            for t in df["text"]:
                seen.update(words(plain(t)))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:  # a partition without words has no column types either
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Values of known words, in arrays by word number; 0 is any unknown word."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.number = {w: i + 1 for i, w in enumerate(counts)}
        for w in {*ENGLISH, *OTHERS, *CONNECTIVES, *SUBORDINATORS, *PRONOUNS}:
            self.number.setdefault(w, len(self.number) + 1)
        size = len(self.number) + 1
        self.rarity = np.full(size, -np.log10(KNOWN_SHARE), dtype=np.float32)
        self.length = np.full(size, 9, dtype=np.float32)
        self.flags = np.zeros((size, 5), dtype=bool)
        for w, i in self.number.items():
            if n := counts.get(w):
                self.rarity[i] = min(self.rarity[0], -np.log10(n / max(total, 1)))
            self.length[i] = len(w)
            self.flags[i] = [w in s for s in self._lists]

    _lists = tuple(map(frozenset, (ENGLISH, OTHERS, CONNECTIVES, SUBORDINATORS, PRONOUNS)))

    def features(self, text: str | None) -> tuple[int, bool, list[float]]:
        """Words of a text, whether it is English, and its features."""
        if not text:
            return 0, False, [0.0] * len(FEATURES)
        low = plain(text)
        ids = np.array([self.number.get(w, 0) for w in words(low)], dtype=np.int64)
        n = len(ids)
        if not n:
            return 0, False, [0.0] * len(FEATURES)
        r, size, flags = self.rarity[ids], self.length[ids], self.flags[ids].mean(axis=0)
        top = np.sort(r)[-max(1, n // 5) :]
        n_words = len(low.split())  # numbers count, too
        values = [r.mean(), (r > 3.5).mean(), size.mean(), (size >= 7).mean(), (size >= 11).mean(), len(np.unique(ids)) / np.sqrt(2 * n), flags[2], flags[3], flags[4], low.count(",") / n, np.log(n), r.std(), size.std(), top.mean()]
        english = bool(flags[0] >= 0.12 and flags[0] > flags[1])
        return n_words, english, [float(v) for v in values]


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, english, x`` of documents; word rarity is counted over all of them.

    A NULL or empty text has no words and is not English. Whole texts are read.
    """
    plain_docs = spread(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"))
    counts = materialize(word_counts(plain_docs.filter(F.col("text").isNotNull())))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = {r[0]: r[1] for r in counts.filter(F.col("n") >= KNOWN_SHARE * total).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(known, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = shared.value
        for df in batches:
            found = [lexicon.features(t) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_words": [f[0] for f in found], "english": [f[1] for f in found], "x": [f[2] for f in found]})

    return plain_docs.mapInPandas(run, "doc_id long, n_words int, english boolean, x array<double>")


def clean_grades(grades: DataFrame) -> DataFrame:
    """``doc_id, grader, band``: one row per document and grader; bands outside 1 to 5 and NULLs are no grades."""
    ok = grades.filter(F.col("doc_id").isNotNull() & F.col("band").between(1, BANDS))
    return ok.groupBy("doc_id", F.coalesce("grader", F.lit("")).alias("grader")).agg(F.max("band").alias("band"))


class OrdinalModel:
    """Proportional-odds regression with a ridge on the weights and an offset for each grader."""

    def __init__(self, ridge: float = RIDGE, steps: int = 400) -> None:
        self.ridge, self.steps = ridge, steps

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z**2 - 1], axis=1)

    def fit(self, x: np.ndarray, grader: np.ndarray, band: np.ndarray) -> OrdinalModel:
        """Fit to rows of features, grader numbers and bands, by Fisher-scaled gradient steps."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        d = self._design(x)
        g = np.zeros((len(x), int(grader.max()) + 1))
        g[np.arange(len(x)), grader] = 1
        a = np.concatenate([d, g], axis=1)
        w = np.zeros(a.shape[1])
        cuts = np.array([np.log((c := np.clip((band <= k).mean(), 0.01, 0.99)) / (1 - c)) for k in range(1, BANDS)])
        lam = np.concatenate([np.full(d.shape[1], self.ridge), np.full(g.shape[1], self.ridge)])
        sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        hess = 0.25 * a.T @ a + np.diag(lam)
        inv = np.linalg.inv(hess)
        n = len(x)
        for _ in range(self.steps):
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            eta = a @ w
            hi, lo = sig(edge[band] - eta), sig(edge[band - 1] - eta)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)
            w = w - inv @ (a.T @ ((dhi - dlo) / p) + lam * w)
            grad = np.zeros(BANDS + 1)
            np.add.at(grad, band, dhi / p)
            np.add.at(grad, band - 1, -dlo / p)
            cuts = np.sort(cuts + 4 * grad[1:BANDS] / n)
        self.weights = w[: d.shape[1]]
        self.cuts = cuts - np.median(w[d.shape[1] :])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The median band of rows of features."""
        return 1 + (self._design(x) @ self.weights[:, None] > self.cuts[None, :]).sum(axis=1)


def fit_levels(features: DataFrame, grades: DataFrame, most: int = MOST_LABELLED) -> OrdinalModel | None:
    """A model fitted on at most ``most`` grades of English documents, by hash; ``None`` without any grade.

    A grader has an offset if they gave one grade in ``MOST_GRADERS`` or more; all others share one. The sample is fitted
    in one task, of which the driver gets the weights alone.
    """
    rows = clean_grades(grades).join(features.filter(F.col("english") & (F.col("n_words") >= LEAST_WORDS)), "doc_id")
    some = rows.select("grader", "band", "x", F.xxhash64("doc_id", "grader").alias("_h"), "doc_id").orderBy("_h", "doc_id").limit(most)

    def fit(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["_h", "doc_id"], kind="stable")
        n = Counter(got["grader"])
        names = {g: i for i, g in enumerate(sorted(g for g, c in n.items() if c * MOST_GRADERS >= len(got)))}
        m = OrdinalModel().fit(np.stack(got["x"].to_numpy()), np.array([names.get(g, len(names)) for g in got["grader"]]), got["band"].to_numpy())
        return pd.DataFrame({c: [getattr(m, c).tolist()] for c in _LEARNT})

    row = some.groupBy(F.lit(1).alias("_all")).applyInPandas(fit, ", ".join(f"{c} array<double>" for c in _LEARNT)).first()
    if row is None:
        return None
    model = OrdinalModel()
    for c in _LEARNT:
        setattr(model, c, np.array(row[c]))
    return model


#: What a fit leaves.
_LEARNT = ("mean", "scale", "weights", "cuts")


def reading_levels(features: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """``doc_id, band`` of English documents of sixty words or more; without a model the middle band."""
    fit = features.filter(F.col("english") & (F.col("n_words") >= LEAST_WORDS)).select("doc_id", "x")
    if model is None:
        return fit.select("doc_id", F.lit((BANDS + 1) // 2).alias("band"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield pd.DataFrame({"doc_id": df["doc_id"], "band": model.predict(np.stack(df["x"].to_numpy()))})

    return fit.mapInPandas(run, "doc_id long, band int")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each English document of sixty words or more with its band."""
    features = materialize(document_features(table(spark, sf_dir, "documents")))
    return reading_levels(features, fit_levels(features, table(spark, sf_dir, "reading_grades"))).distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each genre and band."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "genre", "n_chars")
    return p10_found(spark, sf_dir).join(docs, "doc_id").groupBy("genre", "band").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
ORACLE: dict[str, str] = {}
