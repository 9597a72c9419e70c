"""Problem 4: same or near-same records across splits, by an edit-distance segment join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.operators.skew import salted_join
from rungwork.session import materialize, table

#: Share of the words that may differ, and the fewest words a description must have.
EDITS, LEAST_WORDS = 0.24, 12
#: A sentence is stock when it has so many words and stands in this share of the descriptions, in so many at least.
STOCK_WORDS, STOCK_SHARE, STOCK_LEAST = 6, 0.005, 5
#: Share of a stock sentence's neighbours that must differ, so that copies of one text make none of its sentences stock.
STOCK_SPREAD = 0.8
#: Words of a segment: a cut of a text into one more segment than edits has segments of about 1 / EDITS words.
LENGTHS = (1, 2, 3, 4)
#: Words of a text within which its share of the segments is chosen.
BLOCK = 64
#: Bits of a segment's place in the table of frequencies and in the map of the keys that are looked for; both are fixed.
FREQUENCY_BITS, MAP_BITS = 18, 26
#: Cells of a comparison's table from which its rows are computed in numpy.
LONG = 50_000
#: Rows of texts that hold a segment from which its rows are spread over several keys.
HOT_ROWS = 50_000
#: Numbers of 64 bits that hold a text's marks, and how many of them go with each segment.
MARKS, CARRIED = 16, 2
_EVAL = 0x5851F42D4C957F2D


def sentences(text: Column) -> Column:
    """A text as its sentences: markup and entities dropped, lower case, words apart by single blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&#?[A-Za-z0-9]{1,8};", " ")
    clean = F.transform(F.split(plain, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.filter(clean, lambda s: s != "")


def stock_sentences(texts: DataFrame) -> DataFrame:
    """One row with ``stock``, the sentences that are added to many texts; ``texts`` has ``sents``.

    Texts of the same set of sentences count once, however often they are copied. A text holds a bounded number of
    sentences, so at most that number divided by the share can be stock.
    """
    texts = materialize(texts.groupBy(F.array_sort(F.array_distinct("sents")).alias("_set")).agg(F.min("sents").alias("sents")).drop("_set"))
    n = texts.agg(F.count(F.lit(1)).alias("_n"))
    each = texts.select("sents", F.posexplode("sents").alias("_i", "s")).filter((F.size(F.split("s", " ")) >= STOCK_WORDS) & (F.expr("array_position(sents, s)") == F.col("_i") + 1))
    beside = F.xxhash64(F.coalesce(F.get("sents", F.col("_i") - 1), F.get("sents", F.col("_i") + 1), F.lit("")))
    each = materialize(each.select("s", beside.alias("beside")))
    # at most a text's sentences divided by the share are so frequent, so their neighbours alone are told apart
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), F.col("c") >= F.greatest(F.lit(STOCK_LEAST), STOCK_SHARE * F.col("_n"))).select("s", "c")
    often = each.join(F.broadcast(often), "s").groupBy("s", "c").agg(F.count_distinct("beside").alias("d")).filter(F.col("d") >= STOCK_SPREAD * F.col("c"))
    return often.agg(F.coalesce(F.collect_set("s"), F.array().cast("array<string>")).alias("stock"))


def canonical_bucket(bucket: Column) -> Column:
    """``train``, ``val`` or ``test``; other names in lower case, NULL for NULL."""
    b = F.lower(F.trim(bucket))
    return F.when(b.isin("validation", "dev"), "val").otherwise(b)


def text_classes(segments: DataFrame, splits: DataFrame) -> DataFrame:
    """``segment_id, collection_id, bucket, text_id, sents, n`` of the described segments of the random split.

    Stock sentences are taken off; texts of fewer than twelve words without them, NULL and empty ones are left out.
    Segments whose sentences are the same in any order share ``text_id``. A segment delivered again counts once.
    """
    texts = segments.filter(F.col("segment_id").isNotNull() & F.col("description").isNotNull()).select("segment_id", "collection_id", sentences(F.col("description")).alias("sents")).groupBy("segment_id").agg(F.max("collection_id").alias("collection_id"), F.max("sents").alias("sents"))
    texts = materialize(texts)
    kept = texts.join(F.broadcast(stock_sentences(texts))).withColumn("sents", F.filter("sents", lambda s: ~F.array_contains("stock", s))).drop("stock")
    kept = kept.withColumn("n", F.size(F.split(F.array_join("sents", " "), " "))).filter(F.col("n") >= LEAST_WORDS)
    random = splits.filter((F.col("split_kind") == "random") & (F.col("unit_type") == "segment")).select(F.col("unit").alias("segment_id"), canonical_bucket(F.col("bucket")).alias("bucket")).filter(F.col("bucket").isin("train", "val", "test")).distinct()
    return kept.join(random, "segment_id").withColumn("text_id", F.md5(F.array_join(F.array_sort("sents"), " ")))


def most_edits(n: int) -> int:
    """Words that may differ between two texts of which the longer has ``n`` words."""
    return int(EDITS * n)


_MARK_NAMES = [f"m{i}" for i in range(CARRIED)]
_MARK_TYPES = ", ".join(f"{m} long" for m in _MARK_NAMES)


class _Texts:
    """The texts of a batch as one row of word hashes; ``df`` has ``id, h`` (hashes) and ``sl`` (words of sentences)."""

    def __init__(self, df: pd.DataFrame) -> None:
        self.id = df["id"].to_numpy()
        self.n = np.array([len(x) for x in df["h"]], dtype=np.int64)
        self.h = np.concatenate([*df["h"], np.zeros(max(LENGTHS), np.int64)]).astype(np.int64).view(np.uint64)
        self.first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        size = int(self.n.sum())
        self.pos = np.arange(size) - self.first[self.doc]
        self.left = self.n[self.doc] - self.pos  # words from here to the end of the text
        sl = np.concatenate([*df["sl"]]).astype(np.int64)
        self.s_len = np.repeat(sl, sl)
        self.s_pos = np.arange(size) - np.repeat(np.cumsum(sl) - sl, sl)

    def keys(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each place on; those that go over the end of a text mean nothing."""
        size = len(self.pos)
        with np.errstate(over="ignore"):
            acc = np.full(size, length * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
            for j in range(length):
                acc = (acc ^ self.h[j : j + size]) * np.uint64(0xBF58476D1CE4E5B9)
                acc ^= acc >> np.uint64(31)
        return acc

    def marks(self) -> np.ndarray:
        """Parity marks of each text's words, a word's second and later occurrences as words of their own.

        Two texts that differ by ``d`` words, counted with their occurrences, differ in at most ``d`` marks.
        """
        h = self.h[: len(self.pos)]
        order = np.lexsort((h, self.doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(self.doc[order]) != 0) | (h[order][1:] != h[order][:-1])
        at = np.arange(len(order))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        with np.errstate(over="ignore"):
            x = (h[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        out = np.zeros((len(self.n), MARKS), dtype=np.uint64)
        np.bitwise_xor.at(out, (self.doc[order], (x >> np.uint64(40)).astype(np.int64) % MARKS), np.uint64(1) << (x & np.uint64(63)))
        return out.view(np.int64)


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        if len(df):
            marks = _Texts(df).marks()
            folded = np.bitwise_xor.reduce(marks.reshape(len(df), -1, CARRIED), axis=1)
            yield df.assign(marks=pd.Series(list(marks), index=df.index, dtype=object), **{m: folded[:, i] for i, m in enumerate(_MARK_NAMES)})


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    for df in batches:
        if len(df):
            t = _Texts(df)
            for n in LENGTHS:
                total += np.bincount((t.keys(n)[t.left >= n] >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total))
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"at": at, "c": total[at]})


def rare_segments(cost: np.ndarray, room: np.ndarray, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``(block, place, length)`` of disjoint segments of blocks of words, of least total cost.

    ``cost`` is that of a segment by block, place and length, ``room`` the words from each place to the end of its
    sentence or block, ``wanted`` the number of segments of each block.
    """
    blocks, size, _ = cost.shape
    most, far = int(wanted.max(initial=0)), np.float32(1e18)
    best = np.full((size + 1, blocks, most + 1), far, dtype=np.float32)
    best[:, :, 0] = 0
    took = np.zeros((size, blocks, most + 1), dtype=np.int8)
    for i in range(size - 1, -1, -1):  # from place i on, the least cost of so many segments
        now = best[i + 1].copy()
        for at, n in enumerate(LENGTHS):
            if i + n > size:
                continue
            c = np.where(room[:, i] >= n, cost[:, i, at], far)[:, None] + best[i + n][:, :-1]
            less = c < now[:, 1:]
            now[:, 1:] = np.where(less, c, now[:, 1:])
            took[i][:, 1:] = np.where(less, np.int8(n), took[i][:, 1:])
        best[i] = now
    at, left, every, out = np.zeros(blocks, np.int64), wanted.astype(np.int64), np.arange(blocks), []
    for _ in range(size):
        open_ = at < size
        n = np.where(open_, took[np.minimum(at, size - 1), every, left], 0)
        for length in LENGTHS:
            b = np.nonzero(n == length)[0]
            if len(b):
                out.append((b, at[b], length))
        left -= n > 0
        at += np.maximum(n, 1)
        if not left.any():
            break
    return out


def cut(t: _Texts, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, length, key)`` of the segments of each text: one more than the edits allowed, disjoint, within sentences.

    An edit breaks one segment at most and moving sentences none, so a text of no more words within the edits holds one
    of them. The segments are the rarest such by dynamic programming over blocks of words, each with its share of them.
    """
    n_blocks = -(-t.n // BLOCK)
    k1 = np.array([most_edits(int(n)) + 1 for n in t.n], dtype=np.int64)
    doc = np.repeat(np.arange(len(t.n)), n_blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin, end = nth * t.n[doc] // n_blocks[doc], (nth + 1) * t.n[doc] // n_blocks[doc]
    wanted = (nth + 1) * k1[doc] // n_blocks[doc] - nth * k1[doc] // n_blocks[doc]
    every = [t.keys(n) for n in LENGTHS]
    places, lengths, keys = [], [], []
    for a in range(0, len(doc), 4096):
        d, b, e = doc[a : a + 4096], begin[a : a + 4096], end[a : a + 4096]
        inside = np.arange(BLOCK)[None, :]
        flat = np.minimum(t.first[d][:, None] + b[:, None] + inside, len(t.pos) - 1)
        room = np.minimum((t.s_len - t.s_pos)[flat], (e - b)[:, None] - inside)
        cost = np.stack([frequency[(k[flat] >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)] for k in every], axis=2).astype(np.float32)
        for block, place, length in rare_segments(cost, room, wanted[a : a + 4096]):
            at = flat[block, place]
            places.append(at)
            lengths.append(np.full(len(at), length))
            keys.append(every[LENGTHS.index(length)][at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(lengths), np.concatenate(keys)


def _salts(key: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Over how many keys the rows of a segment are spread."""
    return 1 + (frequency[(key >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)] / HOT_ROWS).astype(np.int64)


def _salted(key: np.ndarray, salt: np.ndarray, cut_by_eval: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key ^ np.uint64(_EVAL if cut_by_eval else 0)) + salt.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _cutter(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency = shared.value
        for df in batches:
            if not len(df):
                continue
            t = _Texts(df)
            at, length, key = cut(t, frequency)
            n = _salts(key, frequency)
            salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, length, key = (np.repeat(x, n) for x in (at, length, key))
            d = t.doc[at]
            k = np.array([most_edits(int(n)) for n in t.n])[d]
            room = np.maximum(t.s_pos[at] - k, 0) << 32 | np.maximum((t.s_len - t.s_pos)[at] - k, 0)
            out = pd.DataFrame({"c_id": t.id[d], "c_n": t.n[d], "room": room, **{m: df[m].to_numpy()[d] for m in _MARK_NAMES}})
            for flag in ("eval", "train"):
                on = df[flag].to_numpy(dtype=bool)[d]
                yield out[on].assign(key=_salted(key[on], salt[on], flag == "eval"), by_eval=flag == "eval")

    return run


def _finder(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, seen = shared.value
        for df in batches:
            if not len(df):
                continue
            t = _Texts(df)
            for n in LENGTHS:
                every = t.keys(n)
                salt = (t.id[t.doc] % _salts(every, frequency)).astype(np.int64)
                for flag in ("train", "eval"):  # the other side cuts
                    key = _salted(every, salt, flag == "train")
                    place = (key.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    at = np.nonzero((t.left >= n) & df[flag].to_numpy(dtype=bool)[t.doc] & ((seen[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))[0]
                    d = t.doc[at]
                    yield pd.DataFrame({"key": key[at], "s_id": t.id[d], "place": t.pos[at] << 32 | t.left[at], **{"s" + m: df[m].to_numpy()[d] for m in _MARK_NAMES}})

    return run


def _dense(rows: DataFrame, size: int, dtype: type) -> np.ndarray:
    """Rows ``at, c`` as an array of fixed size."""
    got, out = rows.toPandas(), np.zeros(size, dtype=np.int64)
    out[got["at"].to_numpy(dtype=np.int64)] = got["c"].to_numpy(dtype=np.int64)
    return out.view(dtype)


def banded_distance(a: list[str], b: list[str], k: int) -> int:
    """Edit distance of two word lists, or ``k + 1`` if it is larger, within a band of ``k`` diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    if n * k > LONG:
        return _long_distance(a, b, k)
    far = k + 1
    prev = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        cur, best = {}, far
        x = a[i - 1]
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if j == 0:
                d = i
            else:
                d = prev.get(j - 1, far) + (x != b[j - 1])
                up, left = prev.get(j, far) + 1, cur.get(j - 1, far) + 1
                d = up if up < d else d
                d = left if left < d else d
            cur[j] = d
            best = d if d < best else best
        if best > k:
            return far
        prev = cur
    return min(prev.get(m, far), far)


def best_place(pattern: list[str], text: list[str], k: int) -> int:
    """Least edit distance of ``pattern`` to a stretch of ``text``, or ``k + 1`` if that is larger."""
    n = len(pattern)
    if len(text) * min(k, n) > LONG:
        return _long_place(pattern, text, k)
    col, last = list(range(n + 1)), min(k, n)
    best = n if n <= k else k + 1
    for word in text:
        diag, top = col[0], 0
        for i in range(1, min(last + 1, n) + 1):
            d = diag + (pattern[i - 1] != word)
            diag = col[i] if i <= last or i == n else k + 1
            d = min(d, diag + 1, top + 1)
            col[i] = top = d
        last = min(last + 1, n)
        while last > 0 and col[last] > k:
            last -= 1
        if last == n and col[n] < best:
            best = col[n]
    return best


def _numbers(*texts: list[str]) -> list[np.ndarray]:
    number: dict[str, int] = {}
    return [np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in texts]


def _long_distance(a: list[str], b: list[str], k: int) -> int:
    """:func:`banded_distance` with a row of the band at a time in numpy."""
    x, y = _numbers(a, b)
    n, m, width = len(x), len(y), 2 * k + 1
    steps, far = np.arange(width), k + 1
    padded = np.concatenate([np.full(k + 1, -1), y, np.full(n + k + 1, -1)])
    row = np.where(steps >= k, np.minimum(steps - k, far), far)  # column j of row i is at j - i + k
    for i in range(1, n + 1):
        now = row + (padded[i : i + width] != x[i - 1])
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        j = steps + (i - k)
        now[(j < 0) | (j > m)] = far
        if i <= k:
            now[k - i] = i
        row = np.minimum(np.minimum.accumulate(now - steps) + steps, far)
        if row.min() >= far:
            return far
    return int(min(row[m - n + k], far))


def _long_place(pattern: list[str], text: list[str], k: int) -> int:
    """:func:`best_place` with a column of the table at a time in numpy."""
    p, t = _numbers(pattern, text)
    steps = np.arange(len(p) + 1)
    col = steps.copy()
    best = int(col[-1])
    for w in t:
        now = np.minimum(col + 1, np.concatenate([[0], col[:-1] + (p != w)]))
        now[0] = 0
        col = np.minimum.accumulate(now - steps) + steps
        best = min(best, int(col[-1]))
    return min(best, k + 1)


def near_same(a: list[str], b: list[str], edits: float = EDITS) -> bool:
    """Whether two texts, given as sentences, are one apart from the order of sentences and ``edits`` of the words.

    ``edits`` is a share of the longer text's words. All but so many of its words must be in the other text as often.
    """
    wa, wb = " ".join(a).split(" "), " ".join(b).split(" ")
    longer = max(len(wa), len(wb))
    k = int(edits * longer)
    if abs(len(wa) - len(wb)) > k or (Counter(wa) & Counter(wb)).total() < longer - k:
        return False
    if banded_distance(wa, wb, k) <= k:
        return True
    for sents, other, n in ((a, wb, len(wa)), (b, wa, len(wb))):
        left = int(edits * n)
        for s in sents:
            left -= best_place(s.split(" "), other, left)
            if left < 0:
                return False
    return True


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        ok = [near_same(list(a), list(b)) for a, b in zip(df["e_sents"], df["t_sents"], strict=True)]
        yield df.loc[ok, ["e_id", "t_id"]]


def _differ(pairs: list[tuple[Column, Column]]) -> Column:
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in pairs[1:]), F.bit_count(pairs[0][0].bitwiseXOR(pairs[0][1])))


def candidates(texts: DataFrame) -> DataFrame:
    """``e, t``: ids of different texts, one of an evaluation split and one of train, that may be nearly the same.

    Of two texts the longer (the evaluation text of two equally long ones) is cut into one more segment than there may
    be edits, and the other must hold one of them, at a place that leaves room for the segment's sentence before and
    after it. ``texts`` has ``id, h, sl, train, eval`` and marks. No pair within the edits is lost: a segment's words
    stand in a row in the other text, lengths differ by the edits at most, and marks by twice the edits less that.
    """
    spark = texts.sparkSession
    columns = texts.select("id", "h", "sl", "train", "eval", *_MARK_NAMES)
    often = texts.select("id", "h", "sl").mapInPandas(_frequencies, "at long, c long").groupBy("at").agg(F.sum("c").alias("c"))
    frequency = _dense(often, 1 << FREQUENCY_BITS, np.int64).astype(np.float32)
    cuts = materialize(columns.mapInPandas(_cutter(spark.sparkContext.broadcast(frequency)), f"c_id long, c_n int, room long, {_MARK_TYPES}, key long, by_eval boolean"))
    place = F.shiftrightunsigned("key", 64 - MAP_BITS)
    bits = cuts.groupBy(F.shiftright(place, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 63 as int)))").alias("c"))
    seen = _dense(bits, 1 << (MAP_BITS - 6), np.uint64)
    found = columns.mapInPandas(_finder(spark.sparkContext.broadcast((frequency, seen))), f"key long, s_id long, place long, {', '.join(f's{m} long' for m in _MARK_NAMES)}")
    differ = _differ([(F.col(m), F.col(f"s{m}")) for m in _MARK_NAMES])
    # two numbers of 32 bits in one: words before and from the segment on, and how many of each the sentence needs
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    n, k = high("place") + low("place"), F.floor(EDITS * F.col("c_n"))
    sizes = (n >= F.col("c_n") - k) & ((n < F.col("c_n")) | (F.col("by_eval") & (n == F.col("c_n"))))
    fits = sizes & (F.col("c_id") != F.col("s_id")) & (high("place") >= high("room")) & (low("place") >= low("room")) & (differ <= 2 * k - F.col("c_n") + n)
    met = cuts.join(found, "key").filter(fits)
    return met.select(F.when(F.col("by_eval"), F.col("c_id")).otherwise(F.col("s_id")).alias("e"), F.when(F.col("by_eval"), F.col("s_id")).otherwise(F.col("c_id")).alias("t")).distinct()


def class_links(classes: DataFrame) -> DataFrame:
    """``e_id, t_id``: different texts, one of an evaluation split and one of train, that are nearly the same.

    Candidates share a segment (:func:`candidates`); those whose marks allow are compared by banded dynamic programming.
    """
    texts = classes.groupBy("text_id").agg(F.min("sents").alias("sents"), F.bool_or(F.col("bucket") == "train").alias("train"), F.bool_or(F.col("bucket") != "train").alias("eval"))
    words = F.split(F.array_join("sents", " "), " ")
    shape = texts.select(F.monotonically_increasing_id().alias("id"), "text_id", "sents", "train", "eval", F.transform(words, lambda w: F.xxhash64(w)).alias("h"), F.transform("sents", lambda s: F.size(F.split(s, " "))).alias("sl"))
    texts = materialize(shape.mapInPandas(_marked, f"id long, text_id string, sents array<string>, train boolean, eval boolean, h array<long>, sl array<int>, marks array<long>, {_MARK_TYPES}"))
    sizes = texts.select("id", F.size("h").alias("n"), "marks")
    near = candidates(texts).join(sizes.toDF("e", "e_n", "e_marks"), "e").join(sizes.toDF("t", "t_n", "t_marks"), "t")
    longer, shorter = F.greatest("e_n", "t_n"), F.least("e_n", "t_n")
    differ = _differ([(F.get("e_marks", F.lit(i)), F.get("t_marks", F.lit(i))) for i in range(MARKS)])
    near = near.filter(differ <= 2 * F.floor(EDITS * longer) - longer + shorter).select("e", "t")
    e = texts.select(F.col("id").alias("e"), F.col("text_id").alias("e_id"), F.col("sents").alias("e_sents"))
    t = texts.select(F.col("id").alias("t"), F.col("text_id").alias("t_id"), F.col("sents").alias("t_sents"))
    return near.join(e, "e").join(t, "t").select("e_id", "t_id", "e_sents", "t_sents").mapInPandas(_verify, "e_id string, t_id string")


def all_links(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and every text that is itself in an evaluation split and in train."""
    same = classes.groupBy("text_id").agg(F.bool_or(F.col("bucket") == "train").alias("t"), F.bool_or(F.col("bucket") != "train").alias("e")).filter("t and e")
    return links.unionByName(same.select(F.col("text_id").alias("e_id"), F.col("text_id").alias("t_id")))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = materialize(text_classes(table(spark, sf_dir, "segments"), table(spark, sf_dir, "splits")))
    return classes, all_links(classes, materialize(class_links(classes)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of segments, one in train and one in val or test, with nearly the same description."""
    classes, links = _links(spark, sf_dir)
    ev = classes.filter("bucket <> 'train'").select(F.col("text_id").alias("e_id"), F.col("segment_id").alias("_e"))
    tr = classes.filter("bucket = 'train'").select(F.col("text_id").alias("t_id"), F.col("segment_id").alias("_t"))
    met = salted_join(salted_join(links, ev, "e_id"), tr, "t_id").filter("_e <> _t")
    return met.select(F.least("_e", "_t").alias("segment_a"), F.greatest("_e", "_t").alias("segment_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation bucket and collection: segments compared and segments whose description is in train too."""
    classes, links = _links(spark, sf_dir)
    hit = links.select(F.col("e_id").alias("text_id")).distinct().withColumn("_hit", F.lit(1))
    return classes.filter("bucket <> 'train'").select("segment_id", "bucket", "collection_id", "text_id").join(hit, "text_id", "left").groupBy("bucket", "collection_id").agg(F.count_distinct("segment_id").alias("n_segments"), F.count("_hit").alias("n_overlapping"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE: dict[str, str] = {}
