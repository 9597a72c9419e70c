"""Ranked incidence complexes: cells with members and supports, their matrices, star form, masks and audits."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungwork.operators.corpus import mentions, term_parts, voices
from rungwork.operators.skew import _parts
from rungwork.session import materialize

GRANULARITIES = ("coarse", "mid", "fine")
#: Rows of a class that are listed together, about; pairs of rows that a task writes, about, in at most so many tasks.
LISTED_ROWS, TASK_PAIRS, MOST_TASKS = 512, 4_000_000, 20_000


@dataclass
class Complex:
    """Cells of ranks 1 to 3 by granularity: who is in them (``members``) and what supports them (``supports``).

    ``cells(granularity, cell_rank, cid, base_term)``, ``members(granularity, cell_rank, cid, narrator)`` and
    ``supports(granularity, cell_rank, cid, segment_id)`` hold distinct rows; ``ground(narrator)`` is rank 0.
    """

    cells: DataFrame
    members: DataFrame
    supports: DataFrame
    ground: DataFrame

    def sizes(self) -> DataFrame:
        """Cells with ``size`` (distinct members) and ``n_segments``; emptied cells have size 0."""
        key = ["granularity", "cell_rank", "cid"]
        m = self.members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        s = self.supports.groupBy(*key).agg(F.count(F.lit(1)).alias("n_segments"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        return self.cells.join(m, key, "left").join(s, key, "left").select(*self.cells.columns, zero("size"), zero("n_segments"))


def _keyed(said: DataFrame) -> DataFrame:
    """``granularity, key, base_term`` of terms of events: the parent, the path, or the path with its place."""
    path = term_parts(F.col("term"))
    coarse = F.when(F.size(path) > 1, F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), " -- ")).otherwise(F.col("term"))
    forms = F.array(*[F.struct(F.lit(g).alias("granularity"), k.alias("key"), b.alias("base_term")) for g, k, b in (("coarse", coarse, coarse), ("mid", F.col("term"), F.col("term")), ("fine", F.concat(F.col("term"), F.lit(" @ "), F.col("place")), F.col("term")))])
    return said.select("segment_id", F.explode(forms).alias("f")).select("segment_id", "f.*")


def complex_supports(segments: DataFrame, rank_map: DataFrame, include_interviewers: bool = False) -> DataFrame:
    """``granularity, cell_rank, cid, base_term, segment_id``: the segments that support each cell.

    ``rank_map`` has ``term, cell_rank``; terms of other ranks make no cell. Rank 1 are segments that someone speaks in.
    An episode takes in the segments of the events whose term lies strictly below its own, found by an equi-join on the
    events' proper prefixes.
    """
    spoken = voices(segments, include_interviewers).select("segment_id").distinct()
    said = mentions(segments).join(spoken, "segment_id", "left_semi").join(rank_map.select("term", "cell_rank").distinct(), "term")
    events = _keyed(said.filter("cell_rank = 2")).select("granularity", F.lit(2).alias("cell_rank"), F.concat(F.lit("r2:"), "key").alias("cid"), "base_term", "segment_id").distinct()
    all_ = F.explode(F.array(*map(F.lit, GRANULARITIES))).alias("granularity")
    own = said.filter("cell_rank = 3").select(all_, F.col("term").alias("base_term"), "segment_id")
    path = term_parts(F.col("base_term"))
    above = F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.array_join(F.slice(path, F.lit(1), i), " -- ")))
    below = events.select("granularity", "segment_id", F.explode(above).alias("base_term"))
    episodes = own.select("granularity", "base_term").distinct()
    taken = own.unionByName(below.join(episodes, ["granularity", "base_term"], "left_semi"))
    upper = taken.select("granularity", F.lit(3).alias("cell_rank"), F.concat(F.lit("r3:"), "base_term").alias("cid"), "base_term", "segment_id").distinct()
    moments = spoken.select(all_, F.lit(1).alias("cell_rank"), F.col("segment_id").alias("cid"), F.lit(None).cast("string").alias("base_term"), "segment_id")
    return moments.unionByName(events).unionByName(upper)


def complex_from_supports(segments: DataFrame, supports: DataFrame, include_interviewers: bool = False, min_cell_size: int = 1) -> Complex:
    """The complex that follows from its supports; cells with fewer than ``min_cell_size`` members are dropped."""
    key = ["granularity", "cell_rank", "cid"]
    members = supports.join(voices(segments, include_interviewers), "segment_id").select(*key, "narrator").distinct()
    cells = supports.select(*key, "base_term").distinct()
    if min_cell_size > 1:
        kept = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= min_cell_size) | (F.col("cell_rank") == 1)).select(*key)
        cells, members, supports = (x.join(kept, key, "left_semi") for x in (cells, members, supports))
    ground = segments.select(F.explode("narrators").alias("narrator")).distinct()
    return Complex(cells, members, supports.select(*key, "segment_id"), ground)


def build_complex(segments: DataFrame, rank_map: DataFrame, include_interviewers: bool = False, min_cell_size: int = 1, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Complex:
    """Complex of cleaned segments at all granularities: :func:`complex_supports`, then :func:`complex_from_supports`.

    ``cut`` is applied to the supports, from which cells and members follow; it may write them once.
    """
    return complex_from_supports(segments, cut(complex_supports(segments, rank_map, include_interviewers)), include_interviewers, min_cell_size)


def triage(sizes: DataFrame, k: int = 50) -> DataFrame:
    """``granularity, pos, cid, size``: the ``k`` events with fewest members, then by key, of each granularity."""
    pos = F.row_number().over(W.partitionBy("granularity").orderBy("size", "cid"))
    return sizes.filter("cell_rank = 2").select("granularity", pos.alias("pos"), "cid", "size", "base_term").filter(F.col("pos") <= k)


def triage_referents(sizes: DataFrame, k: int = 50) -> DataFrame:
    """``granularity, pos, referent``: the triage by referent, each at its first place."""
    events = sizes.filter("cell_rank = 2").withColumn("referent", F.array_join(F.slice(term_parts(F.col("base_term")), 1, 2), " -- "))
    first = events.groupBy("granularity", "referent").agg(F.min(F.struct("size", "cid")).alias("_p"))
    return first.select("granularity", F.row_number().over(W.partitionBy("granularity").orderBy("_p")).alias("pos"), "referent").filter(F.col("pos") <= k)


def summary(sizes: DataFrame) -> DataFrame:
    """Per granularity and rank: cells, mean, median, largest and smallest size, share of singletons."""
    return sizes.groupBy("granularity", "cell_rank").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("size").alias("size_mean"), F.expr("percentile(size, 0.5)").alias("size_median"), F.max("size").alias("size_max"), F.min("size").alias("size_min"), F.avg((F.col("size") == 1).cast("double")).alias("singletons"))


def attestation_histogram(sizes: DataFrame) -> DataFrame:
    """Events by size: 1, 2-3, 4-10, 11-50 and more."""
    band = F.when(F.col("size") <= 1, "1").when(F.col("size") <= 3, "2-3").when(F.col("size") <= 10, "4-10").when(F.col("size") <= 50, "11-50").otherwise(">50")
    return sizes.filter("cell_rank = 2").groupBy("granularity", band.alias("band")).agg(F.count(F.lit(1)).alias("n_cells"))


def extremes(sizes: DataFrame) -> DataFrame:
    """Largest and smallest cell of each rank, the first by key on ties, and the ratio of their sizes."""
    return sizes.groupBy("granularity", "cell_rank").agg(
        F.min(F.struct((-F.col("size")).alias("s"), "cid"))["cid"].alias("largest"),
        F.min(F.struct("size", "cid"))["cid"].alias("smallest"),
        F.try_divide(F.max("size"), F.min("size")).alias("ratio"),
    )


def incidence(cx: Complex, k: int, j: int) -> DataFrame:
    """``granularity, row_cid, col_cid`` of the incidence matrix between ranks ``k`` and ``j``.

    Rank 0 rows are narrators of the ground set; (1, 2) and (1, 3) join on segments; (2, 3) holds where the lower term
    lies strictly below the upper one, by an equi-join on prefixes.
    """
    if (k, j) not in {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}:
        raise ValueError(f"no incidence between ranks {k} and {j}")
    if k == 0:
        return cx.members.filter(F.col("cell_rank") == j).join(cx.ground, "narrator", "left_semi").select("granularity", F.col("narrator").alias("row_cid"), F.col("cid").alias("col_cid"))
    if k == 1:
        lower = cx.cells.filter("cell_rank = 1").select("granularity", F.col("cid").alias("segment_id"))
        return cx.supports.filter(F.col("cell_rank") == j).join(lower, ["granularity", "segment_id"]).select("granularity", F.col("segment_id").alias("row_cid"), F.col("cid").alias("col_cid"))
    path = term_parts(F.col("base_term"))
    above = F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.array_join(F.slice(path, F.lit(1), i), " -- ")))
    low = cx.cells.filter("cell_rank = 2").select("granularity", F.col("cid").alias("row_cid"), F.explode(above).alias("base_term"))
    high = cx.cells.filter("cell_rank = 3").select("granularity", F.col("cid").alias("col_cid"), "base_term")
    return low.join(high, ["granularity", "base_term"]).select("granularity", "row_cid", "col_cid")


def adjacency(edges: DataFrame) -> DataFrame:
    """``granularity, a, b, weight``: rows that share columns, with how many; the diagonal is left out.

    Rows with the same columns are one class (by 128 bits of hash sums), weights are counted between classes, and pairs
    of classes are written out as pairs of lists of their rows, dealt out evenly. So pairs of rows are never shuffled.
    """
    key = ["granularity", "_cls"]
    known = edges.filter(F.col("row_cid").isNotNull())
    hashed = lambda i: F.sum(F.xxhash64("col_cid", F.lit(i)).cast("decimal(38,0)"))
    marks = known.groupBy("granularity", "row_cid").agg(F.count(F.lit(1)).alias("_c"), hashed(0).alias("_h"), hashed(1).alias("_g"))
    rows = materialize(marks.select("granularity", "row_cid", F.md5(F.concat_ws("|", "_c", "_h", "_g")).alias("_cls")))
    classes = materialize(rows.groupBy(*key).agg(F.min("row_cid").alias("row_cid"), F.count(F.lit(1)).alias("_n")))
    columns = materialize(known.join(classes, ["granularity", "row_cid"]).select(*key, "col_cid"))
    x, y = (columns.select("granularity", "col_cid", F.col("_cls").alias(c)) for c in ("_ca", "_cb"))
    weights = x.join(y, ["granularity", "col_cid"]).groupBy("granularity", "_ca", "_cb").agg(F.count(F.lit(1)).alias("weight"))
    for c in "ab":
        weights = weights.join(classes.select("granularity", F.col("_cls").alias(f"_c{c}"), F.col("_n").alias(f"_n{c}")), ["granularity", f"_c{c}"])
    weights = materialize(weights)
    lists = lambda n: F.ceil(F.col(n) / LISTED_ROWS).cast("int")
    listed = rows.join(classes.select(*key, "_n"), key).withColumn("_l", F.pmod(F.xxhash64("row_cid"), lists("_n")).cast("int"))
    listed = materialize(listed.groupBy(*key, "_l").agg(F.collect_list("row_cid").alias("_rows")))
    dealt = weights.withColumn("_la", F.explode(F.sequence(F.lit(0), lists("_na") - 1))).withColumn("_lb", F.explode(F.sequence(F.lit(0), lists("_nb") - 1)))
    for c in "ab":
        dealt = dealt.join(listed.select("granularity", F.col("_cls").alias(f"_c{c}"), F.col("_l").alias(f"_l{c}"), F.col("_rows").alias(f"_{c}")), ["granularity", f"_c{c}", f"_l{c}"])
    pairs = weights.agg(F.coalesce(F.sum((F.col("_na") * F.col("_nb")).cast("double")), F.lit(0.0))).first()[0]
    tasks = max(_parts(edges), min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS)))
    dealt = dealt.select("granularity", "_a", "_b", "weight").repartition(tasks)
    return dealt.withColumn("a", F.explode("_a")).withColumn("b", F.explode("_b")).filter("a <> b").select("granularity", "a", "b", "weight")


def coadjacency(edges: DataFrame) -> DataFrame:
    """``granularity, a, b, weight``: columns that share rows."""
    return adjacency(edges.select("granularity", F.col("col_cid").alias("row_cid"), F.col("row_cid").alias("col_cid")))


def star(cx: Complex) -> tuple[DataFrame, DataFrame]:
    """Typed star expansion: nodes ``granularity, node, cell_rank`` and edges ``granularity, src, dst, etype``."""
    nodes = cx.cells.select("granularity", F.col("cid").alias("node"), "cell_rank").unionByName(cx.ground.select(F.explode(F.array(*map(F.lit, GRANULARITIES))).alias("granularity"), F.col("narrator").alias("node"), F.lit(0).alias("cell_rank")))
    within = cx.members.select("granularity", F.col("narrator").alias("src"), F.col("cid").alias("dst"), F.concat(F.lit("in_r"), "cell_rank").alias("etype"))
    moments = cx.cells.filter("cell_rank = 1").select("granularity", F.col("cid").alias("segment_id"))
    proof = cx.supports.filter("cell_rank > 1").join(moments, ["granularity", "segment_id"], "left_semi").select("granularity", F.col("segment_id").alias("src"), F.col("cid").alias("dst"), F.concat(F.lit("supports_r"), "cell_rank").alias("etype"))
    return nodes, within.unionByName(proof)


def star_roundtrip(cx: Complex) -> DataFrame:
    """``granularity, n_missing, n_extra``: members lost and won when cells are rebuilt from the star form."""
    _, edges = star(cx)
    back = edges.filter(F.col("etype").startswith("in_r")).select("granularity", F.substring_index("etype", "_r", -1).cast("int").alias("cell_rank"), F.col("dst").alias("cid"), F.col("src").alias("narrator"))
    key = ["granularity", "cell_rank", "cid", "narrator"]
    both = cx.members.withColumn("_o", F.lit(1)).join(back.withColumn("_b", F.lit(1)), key, "full_outer")
    return both.groupBy("granularity").agg(F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_o").isNull()).alias("n_extra"))


def support_injectivity(cx: Complex) -> DataFrame:
    """Per granularity and rank: cells, distinct member sets, most cells on one set, collapse factor, shared sets."""
    sets = cx.members.groupBy("granularity", "cell_rank", "cid").agg(F.array_join(F.array_sort(F.collect_set("narrator")), "\x1f").alias("_s"))
    same = sets.groupBy("granularity", "cell_rank", F.md5("_s").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return same.groupBy("granularity", "cell_rank").agg(F.sum("_n").alias("n_cells"), F.count(F.lit(1)).alias("n_supports"), F.max("_n").alias("max_multiplicity"), (F.sum("_n") / F.count(F.lit(1))).alias("collapse"), F.count_if(F.col("_n") > 1).alias("n_shared"))


def concordance(sizes: DataFrame) -> DataFrame:
    """Per granularity: pairs of cells of different rank in which the higher is larger, smaller or as large.

    Pairs are counted from the histogram of sizes of each rank, never formed.
    """
    h = sizes.groupBy("granularity", "cell_rank", "size").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = (h.select("granularity", F.col("cell_rank").alias(f"r{x}"), F.col("size").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in ("l", "h"))
    pairs = lo.join(hi, "granularity").filter("rl < rh").withColumn("_p", F.col("nl") * F.col("nh"))
    return pairs.groupBy("granularity").agg(*[F.coalesce(F.sum(F.when(c, F.col("_p"))), F.lit(0)).alias(n) for n, c in (("n_concordant", F.col("sh") > F.col("sl")), ("n_inverted", F.col("sh") < F.col("sl")), ("n_tied", F.col("sh") == F.col("sl")))])


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add the mean rank of ``value`` among equal values, within ``by``, from a histogram of the values."""
    h = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = h.select(*by, F.col(value), (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, rho``: rank correlation of two columns."""
    both = average_ranks(average_ranks(df.select(*by, x, y), by, x, "_rx"), by, y, "_ry")
    return both.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def sanity(cx: Complex) -> DataFrame:
    """Per granularity: empty moments, cells of other ranks, members outside the ground set, share of orphan moments."""
    sizes = cx.sizes()
    base = sizes.groupBy("granularity").agg(F.count_if((F.col("cell_rank") == 1) & (F.col("size") == 0)).alias("n_empty_moments"), F.count_if(~F.col("cell_rank").isin(1, 2, 3)).alias("n_bad_rank"))
    out = cx.members.join(cx.ground, "narrator", "left_anti").groupBy("granularity").agg(F.count(F.lit(1)).alias("n_outside"))
    used = incidence(cx, 1, 2).select("granularity", F.col("row_cid").alias("cid")).distinct().withColumn("_u", F.lit(1))
    orphans = cx.cells.filter("cell_rank = 1").join(used, ["granularity", "cid"], "left").groupBy("granularity").agg(F.avg(F.col("_u").isNull().cast("double")).alias("orphans"))
    return base.join(out, "granularity", "left").join(orphans, "granularity").select("granularity", "n_empty_moments", "n_bad_rank", F.coalesce("n_outside", F.lit(0).cast("long")).alias("n_outside"), "orphans")


def mask(cx: Complex, keep: DataFrame) -> Complex:
    """The complex with only the kept ``(narrator, cid)`` pairs in ranks 2 and 3; emptied cells stay, ranks 0 and 1 too."""
    upper = cx.members.filter("cell_rank >= 2").join(keep.select("narrator", "cid").distinct(), ["narrator", "cid"], "left_semi")
    return Complex(cx.cells, cx.members.filter("cell_rank < 2").unionByName(upper), cx.supports, cx.ground)


def restrict(cx: Complex, narrators: DataFrame) -> Complex:
    """The complex over some narrators; cells that lose all members are dropped."""
    members = cx.members.join(narrators.select("narrator").distinct(), "narrator", "left_semi")
    key = ["granularity", "cell_rank", "cid"]
    left = members.select(*key).distinct()
    return Complex(cx.cells.join(left, key, "left_semi"), members, cx.supports.join(left, key, "left_semi"), cx.ground.join(narrators, "narrator", "left_semi"))


def drop_terms(segments: DataFrame, flagged: DataFrame) -> DataFrame:
    """Cleaned segments without the flagged ``term`` s."""
    kept = mentions(segments).join(flagged.select("term").distinct(), "term", "left_anti").groupBy("segment_id").agg(F.array_sort(F.collect_set("term")).alias("_t"))
    return segments.join(kept, "segment_id", "left").withColumn("terms", F.coalesce("_t", F.array().cast("array<string>"))).drop("_t")
