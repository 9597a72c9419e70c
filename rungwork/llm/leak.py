"""Problem 8: evaluation passages inside training documents, by random-walk embedding and bit sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.session import spread, table

#: Words of a window and of the shortest leak, and edits that a window may hold.
WINDOW, EDITS = 20, 2
#: Walks, samples of each walk, coordinates of a sample and steps they are taken from.
WALKS, SAMPLES, COORDINATES, STEPS = 4, 8, 6, 2 * WINDOW
#: Most passage words that are sent to the executors at once; more are taken in blocks, each against all documents.
BLOCK_WORDS = 500_000
#: A sentence before or after so many different passages is an instruction.
SHARED = 3
#: Characters of text that are worked on at once.
CHARS = 2_000_000

_TAG = re.compile(r"<[^<>]{0,300}>|&#?\w{1,8};|\[[A-Za-z ]{1,24}\]")
#: Page marks and speaker labels at the start of a line are layout.
_LAYOUT = re.compile(r"(?m)^\s*(?:page \d+(?: of \d+)?|[-–—\[( ]*\d{1,4}[-–—\]) ]*)\s*$|^\s*[A-Z]{1,3}:\s|^\s*[QA][:.]\s", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
#: A word parted at the end of a line.
_PARTED = re.compile("(?<=\\w)(?:-[ \\t]*\\n\\s*|\u00ad\\s*)(?=\\w)")


def words(text: str | None) -> list[str]:
    """Lower-case words of a text without markup, entities, page marks, speaker labels and hyphens at line ends."""
    return _WORD.findall(_LAYOUT.sub(" ", _PARTED.sub("", _TAG.sub(" ", text))).lower()) if text else []


def _long_first(sents: Column) -> Column:
    """The distinct sentences that are no questions, in lower case and by falling number of words, as ``n, s``."""
    plain = F.array_distinct(F.transform(F.filter(sents, lambda s: ~s.endswith("?")), lambda s: F.lower(s)))
    return F.sort_array(F.transform(plain, lambda s: F.struct((-F.size(F.split(s, r"\s+"))).alias("n"), s.alias("s"))))


def instructions(texts: DataFrame) -> DataFrame:
    """``_key``: sentences that stand beside at least ``SHARED`` different passages; ``texts`` has ``sents``.

    A passage is known by its two longest sentences, the second if it is at least half as long, and both must differ:
    items that reuse one passage, or copies of it with a sentence changed, count once. The longest sentence of a text is
    no instruction there.
    """
    distinct = texts.select(_long_first(F.col("sents")).alias("a")).distinct()
    each = distinct.select("a", F.posexplode("a").alias("i", "x")).filter("i > 0")
    one, two = F.col("a")[0], F.get(F.filter("a", lambda y: y["s"] != F.col("x")["s"]), F.lit(1))
    second = F.when(2 * two["n"] <= one["n"], two["s"]).otherwise(one["s"])
    spread_ = each.groupBy(F.col("x")["s"].alias("_key")).agg(F.count_distinct(one["s"]).alias("_p"), F.count_distinct(second).alias("_q"))
    return spread_.filter(F.least("_p", "_q") >= SHARED).select("_key")


def passages(items: DataFrame) -> DataFrame:
    """``item_id, passage``: the text of each item without the instructions and questions before and after it.

    A sentence that ends in a question mark is a question; for instructions see :func:`instructions`. Inside a passage
    both are part of it. Items with NULL id or text are left out, and those of nothing else.
    """
    cut = F.filter(F.transform(F.split("text", r"(?<=[.!?:])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    texts = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", cut.alias("sents")).distinct()
    told = instructions(texts).withColumn("_told", F.lit(True))
    parts = texts.select("item_id", "sents", F.posexplode("sents").alias("i", "s")).withColumn("_key", F.lower("s")).join(told, "_key", "left")
    own = F.when(~(F.coalesce("_told", F.lit(False)) | F.col("s").endswith("?")), F.col("i"))
    ends = parts.groupBy("item_id", "sents").agg(F.min(own).alias("_a"), F.max(own).alias("_z")).filter("_a is not null")
    return ends.select("item_id", F.array_join(F.slice("sents", F.col("_a") + 1, F.col("_z") - F.col("_a") + 1), " ").alias("passage"))


@dataclass
class Index:
    """Passages of one block of items and the keys of their windows."""

    vocabulary: dict[str, int]
    bigrams: np.ndarray
    pieces: list[tuple[int, np.ndarray]]
    keys: np.ndarray
    places: np.ndarray
    multipliers: np.ndarray
    samples: np.ndarray
    weights: np.ndarray


_MASK = (1 << 22) - 1


def _bigram(ids: np.ndarray) -> np.ndarray:
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    h = a * 2654435761 + b * 40503 * 65537
    return ((h ^ (h >> 22)) & _MASK).astype(np.int32)


def embed_keys(ids: np.ndarray, starts: np.ndarray, ix: Index) -> np.ndarray:
    """Keys of the windows that begin at ``starts``, one column for each sample of each walk.

    A walk copies the word under its pointer at every step and moves on if a random bit of step and word is set, so
    windows a few edits apart soon run in step again and differ at few steps; a sample is the words at some steps.
    """
    out = np.empty((len(starts), WALKS * SAMPLES), dtype=np.int64)
    padded = np.concatenate([ids, np.zeros(WINDOW + 1, dtype=ids.dtype)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        for w in range(WALKS):
            acc = np.zeros((SAMPLES, len(starts)), dtype=np.uint64)
            p = np.zeros(len(starts), dtype=np.int64)
            for j in range(STEPS):
                sym = np.where(p < WINDOW, padded[starts + p], 0).astype(np.uint64)
                for s in np.nonzero(ix.samples[w, :, j])[0]:
                    acc[s] += (sym + np.uint64(1)) * ix.weights[w, s, j]
                p += ((((sym + np.uint64(j + 1)) * ix.multipliers[w, j]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
            for s in range(SAMPLES):
                out[:, w * SAMPLES + s] = (acc[s] ^ (acc[s] >> np.uint64(32))).view(np.int64) * 64 + (w * SAMPLES + s)
    return out


def build_index(rows: list[tuple[int, str]], seed: int = 11) -> Index:
    """Index of ``(item_id, passage)`` rows."""
    rng = np.random.default_rng(seed)
    samples = np.zeros((WALKS, SAMPLES, STEPS), dtype=bool)
    for w in range(WALKS):
        for s in range(SAMPLES):
            samples[w, s, rng.choice(STEPS, COORDINATES, replace=False)] = True
    odd = lambda *shape: rng.integers(1, 1 << 62, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ix = Index({}, np.zeros(_MASK + 1, dtype=bool), [], np.empty(0, np.int64), np.empty((0, 2), np.int32), odd(WALKS, STEPS), samples, odd(WALKS, SAMPLES, STEPS))
    keys, places = [], []
    for item, passage in rows:
        found = words(passage)
        if len(found) < WINDOW:
            continue
        ids = np.array([ix.vocabulary.setdefault(x, len(ix.vocabulary) + 1) for x in found], dtype=np.int32)
        ix.bigrams[_bigram(ids)] = True
        starts = np.arange(len(ids) - WINDOW + 1)
        k = embed_keys(ids, starts, ix)
        keys.append(k.ravel())
        places.append(np.stack([np.full(k.size, len(ix.pieces)), np.repeat(starts, k.shape[1])], axis=1))
        ix.pieces.append((item, ids))
    if keys:
        flat, at = np.concatenate(keys), np.concatenate(places).astype(np.int32)
        order = np.argsort(flat, kind="stable")
        ix.keys, ix.places = flat[order], at[order]
    return ix


def aligned_run(a: np.ndarray, b: np.ndarray, band: int = 8) -> bool:
    """Whether ``a``, aligned with ``b`` around the main diagonal, holds a run of a window's words with few edits.

    The run begins and ends with an equal word and has at most an edit in ten words.
    """
    n, m, far = len(a), len(b), 1 << 20
    cost = [[far] * (2 * band + 1) for _ in range(n + 1)]
    for d in range(2 * band + 1):
        if 0 <= d - band <= m:
            cost[0][d] = 0  # words of b before the first of a are free
    al, bl = a.tolist(), b.tolist()
    for i in range(1, n + 1):
        up, row, x = cost[i - 1], cost[i], al[i - 1]
        for d in range(2 * band + 1):
            j = i + d - band
            if j < 0 or j > m:
                continue
            best = up[d] + (x != bl[j - 1]) if j else far
            if d < 2 * band and up[d + 1] + 1 < best:
                best = up[d + 1] + 1
            if d and row[d - 1] + 1 < best:
                best = row[d - 1] + 1
            row[d] = best
    d = min(range(2 * band + 1), key=lambda e: cost[n][e])
    i, ops = n, []
    while i > 0:
        j, c = i + d - band, cost[i][d]
        if j and cost[i - 1][d] + (al[i - 1] != bl[j - 1]) == c:
            ops.append(al[i - 1] == bl[j - 1])
            i -= 1
        elif d < 2 * band and cost[i - 1][d + 1] + 1 == c:
            ops.append(False)
            i, d = i - 1, d + 1
        else:
            ops.append(None)  # a word of b that a doesn't have
            d -= 1
    for s in range(len(ops)):
        if ops[s] is not True:
            continue
        span = wrong = 0
        for o in ops[s:]:
            span += o is not None
            wrong += o is not True
            if wrong > 8:
                break
            if span >= WINDOW and o is True and wrong <= max(EDITS, span // 10):
                return True
    return False


def straight_run(same: np.ndarray) -> bool:
    """Whether a stretch of a window's length, equal at both ends, has few words replaced."""
    wrong = np.concatenate([[0], np.cumsum(~same)])
    few = wrong[WINDOW:] - wrong[:-WINDOW] <= EDITS
    return bool((few & same[: len(few)] & same[WINDOW - 1 :]).any())


def alike(a: np.ndarray, b: np.ndarray, shift: int, left: int, right: int) -> bool:
    """Whether some window of ``a`` has nearly all its words in ``b`` close by, as any aligned run has."""
    near = np.zeros(right - left, dtype=bool)
    for d in range(shift - 8, shift + 9):
        lo, hi = max(left, -d), min(right, len(b) - d)
        if hi > lo:
            near[lo - left : hi - left] |= a[lo:hi] == b[lo + d : hi + d]
    total = np.concatenate([[0], np.cumsum(near)])
    return bool((total[WINDOW:] - total[:-WINDOW] >= WINDOW - EDITS).any())


def scan(texts: list[str | None], ix: Index) -> list[tuple[int, int]]:
    """``(index of text, item)`` of the passages found in some texts."""
    if not len(ix.keys):
        return []
    get = ix.vocabulary.get
    lists = [[get(w, 0) for w in words(t)] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # an unknown word parts the texts
    ids = np.zeros(int(first[-1]) + WINDOW, dtype=np.int32)
    for x, at in zip(lists, first, strict=False):
        ids[at : at + len(x)] = x
    known = ix.bigrams[_bigram(ids)] & (ids[:-1] > 0) & (ids[1:] > 0)
    total = np.concatenate([[0], np.cumsum(known)])
    # an edit breaks two pairs of neighbours at most, so a window with fewer known pairs holds too many edits
    starts = np.nonzero(total[WINDOW - 1 :] - total[: -(WINDOW - 1)] >= WINDOW - 1 - 2 * EDITS)[0]
    if not len(starts):
        return []
    keys = embed_keys(ids, starts, ix)
    flat = keys.ravel()
    lo, hi = np.searchsorted(ix.keys, flat), np.searchsorted(ix.keys, flat, side="right")
    n = hi - lo
    hit = np.nonzero(n)[0]
    n = n[hit]
    place = ix.places[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    at = np.repeat(starts[hit // keys.shape[1]], n)
    # of all windows of a passage at one distance from the text, the first stands for all
    docs = np.searchsorted(first, at, side="right") - 1
    _, one = np.unique(np.stack([docs, at - place[:, 1], place[:, 0]]), axis=1, return_index=True)
    found: set[tuple[int, int]] = set()
    for doc, begin_at, (piece, begin) in zip(docs[one].tolist(), at[one].tolist(), place[one].tolist(), strict=True):
        item, a = ix.pieces[piece]
        if (doc, item) in found:
            continue
        shift = begin_at - begin
        left, right = max(0, int(first[doc]) - shift), min(len(a), int(first[doc] + sizes[doc]) - shift)
        if right - left < WINDOW:
            continue
        if straight_run(a[left:right] == ids[shift + left : shift + right]) or (alike(a, ids, shift, left, right) and aligned_run(a[left:right], ids[shift + left : min(int(first[doc] + sizes[doc]), shift + right + 8)])):
            found.add((doc, item))
    return sorted(found)


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id``: documents that hold at least a window's words in a row of an item's passage.

    The items are a stated query set; they are taken in blocks of bounded size against all documents. NULL and empty
    texts hold nothing; repeated rows give one row.
    """
    spark = docs.sparkSession
    size = F.size(F.split("passage", r"\s+"))
    sized = passages(items).withColumn("_n", size).filter(F.col("_n") > 0)
    n_blocks = -(-int(sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // block_words)
    plain = spread(docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    out = None
    for b in range(max(1, n_blocks)):
        rows = [(r[0], r[1]) for r in sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks))) == b).select("item_id", "passage").orderBy("item_id", "passage").toLocalIterator()]
        shared = spark.sparkContext.broadcast(build_index(rows))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix = shared.value
            for df in batches:
                at = df["text"].str.len().cumsum().floordiv(CHARS).to_numpy()
                for _, part in df.groupby(at):
                    found = scan(part["text"].tolist(), ix)
                    ids = part["doc_id"].to_numpy()
                    yield pd.DataFrame({"doc_id": [ids[d] for d, _ in found], "item_id": [i for _, i in found]}, dtype="int64")

        part = plain.mapInPandas(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "bucket").distinct()
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents")).join(items, "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLE: dict[str, str] = {}
