"""Problem 9: mixing sources to target weights, by iterative proportional fitting."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.keys import canonical_key
from rungwork.session import materialize, spread, table

#: Vocabulary whose tokens are the unit of size.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A topic that holds less than this share of the documents is counted with the others, so there are at most so many.
TOPIC_SHARE = 0.001
ROUNDS, SETTLED = 200, 1e-7
#: Bits of a document's hash; bins of a level and the bits that each level leaves to the next.
PLACE_BITS, BINS, LEVELS = 40, 4096, (32, 20, 8)
#: Spellings of language codes.
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "es": "es", "spa": "es", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "it": "it", "ita": "it", "pt": "pt", "por": "pt", "nl": "nl", "nld": "nl"}


def encoder(path: str = VOCABULARY):
    """Encoding of a ``.tiktoken`` vocabulary file; special tokens' strings are ordinary text."""
    import tiktoken

    pattern = importlib.import_module("public_tokenizers").PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def canonical_source(c: Column) -> Column:
    """Lower case, blanks squeezed, ``_`` as ``-``; NULL and blank stay NULL."""
    return F.translate(canonical_key(c), "_", "-")


def canonical_language(c: Column) -> Column:
    """Two-letter code of a spelling of a language; ``other`` for any that isn't listed and NULL."""
    code = F.regexp_extract(F.lower(F.trim(c)), "^[a-z]+", 0)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.lit("other"))


def sized_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens``: canonical columns of documents and their size in tokens.

    A NULL text has no tokens. Whole texts are encoded.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "source": df["source"], "lang": df["lang"], "topic": df["topic"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in df["text"]]})

    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", canonical_source(F.col("source")).alias("source"), canonical_language(F.col("lang")).alias("lang"), F.coalesce(canonical_key(F.col("genre")), F.lit("other")).alias("topic"), "text")
    return spread(named).mapInPandas(count, "doc_id long, source string, lang string, topic string, n_tokens long")


def clean_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Target share and most repeats of each source; a source named twice gets the sum of its shares.

    The list is a statement of the user and of fixed size. Rows without source or positive share are ignored, and a
    NULL or smaller number of repeats is one. Shares are scaled to add up to 1.
    """
    rows = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0").collect()
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        share, most = out.get(r["source"], (0.0, 1))
        out[r["source"]] = (share + r["target_share"], max(most, r["max_repeats"] or 1))
    total = sum(s for s, _ in out.values())
    return {k: (s / total, m) for k, (s, m) in out.items()}


@dataclass
class Plan:
    """Expected copies of a document of each cell, and the tokens of the whole mixture."""

    copies: dict[tuple[str, str, str], float]
    tokens: float
    #: Rounds of fitting and the last one's largest change, as a share of all tokens.
    rounds: int = 0
    change: float = 0.0

    @property
    def converged(self) -> bool:
        return self.change < SETTLED


def rake(cells: dict[tuple[str, str, str], float], targets: dict[str, tuple[float, int]], rounds: int = ROUNDS, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> Plan:
    """Token weights of ``(source, language, topic)`` cells that meet the sources' shares.

    The size of the mixture is the largest at which every source that has documents can give its share with its
    repeats; shares of absent sources go to the others in proportion. ``languages`` and ``topics`` are the shares wanted
    of those, scaled to those that have documents; where they aren't given, the shares that they have among all tokens
    of the listed sources. They are raked to as far as the cap of each cell lets them; sources come last in each round,
    so their shares hold. Whether the fitting settled is told by the plan.
    """
    have: dict[str, float] = {}
    for (s, _, _), n in cells.items():
        if s in targets and n > 0:
            have[s] = have.get(s, 0.0) + n
    if not have:
        return Plan({}, 0.0)
    cells = {k: n for k, n in cells.items() if k[0] in have and n > 0}
    share = {s: targets[s][0] / sum(targets[x][0] for x in have) for s in have}
    size = min(have[s] * targets[s][1] / share[s] for s in have)
    total = sum(cells.values())
    margins = []
    for axis, named in ((1, languages), (2, topics)):
        m: dict[str, float] = {}
        for k, n in cells.items():
            m[k[axis]] = m.get(k[axis], 0.0) + n / total * size
        if named:
            most = sum(max(0.0, named.get(x, 0.0)) for x in m)
            m = {x: max(0.0, named.get(x, 0.0)) / most * size for x in m} if most else m
        margins.append((axis, m))
    margins.append((0, {s: share[s] * size for s in have}))
    names = list(cells)
    have_of = np.array([cells[k] for k in names])
    cap = have_of * np.array([targets[k[0]][1] for k in names])
    w = np.array([cells[k] * share[k[0]] * size / have[k[0]] for k in names])
    sides = []
    for axis, m in margins:
        values = sorted(m)
        number = {x: i for i, x in enumerate(values)}
        sides.append((axis, np.array([number[k[axis]] for k in names]), np.array([m[x] for x in values])))
    change, done = 0.0, 0
    for done in range(1, rounds + 1):
        before = w.copy()
        for axis, at, want in sides:
            for _fill in range(20 if axis == 0 else 1):
                open_ = w < cap * (1 - 1e-12)
                now, free = np.bincount(at, w, len(want)), np.bincount(at, np.where(open_, w, 0.0), len(want))
                short = want - now
                # a cell at its cap can't grow: the others of its margin make up for it
                base = np.where(short > 0, free, now)
                factor = np.maximum(0.0, 1 + np.divide(short, base, out=np.zeros_like(short), where=base > 0))
                new = np.where((open_ | (short <= 0)[at]) & (base > 0)[at], np.minimum(cap, w * factor[at]), w)
                moved = float(np.abs(new - w).max()) / size
                w = new
                if moved < 1e-9:
                    break
        change = float(np.abs(w - before).max()) / size
        if change < SETTLED:
            break
    return Plan({k: float(v) for k, v in zip(names, w / have_of, strict=True)}, size, done, change)


def _bounds(drawn: DataFrame, wanted: dict[str, float]) -> dict[str, int]:
    """For each source the bound of ``_v`` below which documents hold the wanted tokens, to within a document.

    The bound is narrowed down by histograms of ``_v`` per source, of a fixed number of bins; each level looks into the
    bin in which the last one passed the wanted number. ``drawn`` has ``source, _v, n_tokens``.
    """
    spark = drawn.sparkSession
    at = {s: (0, 0.0) for s in wanted}
    for shift in LEVELS:
        rows = spark.createDataFrame([(s, lo) for s, (lo, _) in sorted(at.items())], "source string, _lo long")
        near = drawn.join(F.broadcast(rows), "source").select("source", F.shiftright(F.col("_v") - F.col("_lo"), shift).alias("_b"), "n_tokens").filter((F.col("_b") >= 0) & (F.col("_b") < BINS))
        bins: dict[str, list[tuple[int, float]]] = {}
        for r in near.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t")).collect():
            bins.setdefault(r["source"], []).append((r["_b"], float(r["t"])))
        for s, (lo, sum_) in at.items():
            last = BINS
            for b, t in sorted(bins.get(s, [])):
                if sum_ + t > wanted[s]:
                    # of the last level's bin, a document as a rule, the nearer end is taken
                    last = b if shift != LEVELS[-1] or 2 * (wanted[s] - sum_) < t else b + 1
                    break
                sum_ += t
            at[s] = (lo + (last << shift), sum_) if last < BINS or shift != LEVELS[0] else (1 << 62, sum_)
    return {s: lo for s, (lo, _) in at.items()}


def mixture(sized: DataFrame, targets: dict[str, tuple[float, int]], seed: int = 0, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the documents that are in the mixture.

    A document of a cell with ``c`` expected copies is taken ``floor(c)`` times, so never more often than its source
    allows, and once more if its hash, divided by the rest of ``c``, falls below its source's bound. The bound is
    calibrated on tokens, so a source's tokens are those of the plan to within one document. Empty documents and
    unlisted sources are left out.
    """
    n = sized.agg(F.count(F.lit(1)).alias("_n"))
    often = sized.groupBy("topic").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(n), F.col("_c") >= TOPIC_SHARE * F.col("_n")).select("topic", F.lit(True).alias("_often"))
    folded = sized.filter(F.col("source").isin(*targets) & (F.col("n_tokens") > 0)).join(F.broadcast(often), "topic", "left").withColumn("topic", F.when(F.col("_often"), F.col("topic")).otherwise("other")).drop("_often")
    cells = {(r["source"], r["lang"], r["topic"]): float(r["t"]) for r in folded.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = rake(cells, targets, languages=languages, topics=topics)
    spark = sized.sparkSession
    whole = {k: int(c + 1e-9) for k, c in plan.copies.items()}
    rest = {k: max(0.0, c - whole[k]) for k, c in plan.copies.items()}
    rest = {k: 0.0 if f < 1e-9 else f for k, f in rest.items()}
    rates = spark.createDataFrame([(*k, whole[k], rest[k]) for k in sorted(plan.copies)], "source string, lang string, topic string, _whole int, _rest double")
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << PLACE_BITS))
    drawn = folded.join(F.broadcast(rates), ["source", "lang", "topic"]).withColumn("_v", F.when(F.col("_rest") > 0, F.floor(place / F.col("_rest"))))
    wanted: dict[str, float] = {}
    for k, f in rest.items():
        if f > 0:
            wanted[k[0]] = wanted.get(k[0], 0.0) + f * cells[k]
    bounds = spark.createDataFrame(sorted(_bounds(drawn.filter("_v is not null").select("source", "_v", "n_tokens"), wanted).items()), "source string, _bound long")
    more = F.coalesce(F.col("_v") < F.col("_bound"), F.lit(False)).cast("int")
    return drawn.join(F.broadcast(bounds), "source", "left").select("doc_id", "source", "n_tokens", (F.col("_whole") + more).alias("copies")).filter("copies > 0")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    targets = clean_targets(table(spark, sf_dir, "mix_targets"))
    return mixture(materialize(sized_documents(table(spark, sf_dir, "documents"))), targets), targets


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is taken."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: target share, share reached, documents, tokens and most copies."""
    mixed, targets = _mixed(spark, sf_dir)
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    want = spark.createDataFrame([(s, t, m) for s, (t, m) in sorted(targets.items())], "source string, target_share double, max_repeats int")
    total = got.agg(F.sum("n_tokens").alias("_t"))
    both = F.broadcast(want).join(got, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("source", "target_share", "max_repeats", zero("n_documents").alias("n_documents"), zero("n_tokens").alias("n_tokens"), zero("most_copies").alias("most_copies"), F.round(F.coalesce(F.try_divide("n_tokens", F.col("_t")), F.lit(0.0)), 6).alias("share"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
