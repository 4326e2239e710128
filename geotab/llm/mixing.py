"""Mixing sources to target token weights by entropy balancing.

Targets: a source may give at most CAP times its words; weights share the wanted total and what
exceeds a source's limit is shared anew among the others (water filling, in rounds of grouped sums).

Rates: the rates nearest to one copy of each document in relative entropy, under one word constraint for
each source and the limit CAP for each document, are min(CAP, exp(lambda * x)), with lambda the dual of
the source's constraint and x what a document adds to it: its size over the mean size of its source. So a
source that must shrink gives up long documents before short ones, and one that must grow repeats long
ones first. A tilt column may take the place of x. Newton steps on the logarithm of the words got
solve the convex dual, kept between bounds that close in; each is a grouped sum over the distributed
(source, x) table.

Copies: in buckets of about BUCKET documents of one source, ordered by size, cumulated rates are rounded
to whole copies. Words then missing or left over are met by whole copies of documents that fit into the gap, largest
first, FILLS times over; what still stays open is less than the next document and is closed by one
partial copy, from the smallest document on, so every bucket meets its share.

Defined cases: null or blank text has size 0 and takes 0 words; a null source is a source of its own,
last in order; repeated rows are documents of their own, and a row repeated more often than a bucket holds is dealt to all
buckets of its source; an empty table gives no rows; columns other
than those asked for pass through expand() untouched. The same input gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
BUCKET = 512
FILLS = 2
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of runs outside [\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with _n, their rank by code point from 0, null last: ranks within ranges, moved by the sizes of those before."""
    n = sources.count()
    ranges = cut(sources.repartitionByRange(max(1, n // 100_000), F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    sizes = {r[0]: r[1] for r in ranges.groupBy("_range").count().collect()}  # a row for each 100 000 sources
    before = [0]
    for k in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(k, 0))
    moved = F.get(F.array(*[F.lit(x) for x in before]).cast("array<long>"), F.col("_range"))
    return ranges.withColumn("_n", moved + rank - 1).drop("_range")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, ...), a row for each, with its target words."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = numbered(sources).withColumn("_w", F.get(cycle, (F.col("_n") % len(weights)).cast("int"))).withColumn("_limit", F.lit(float(cap)) * F.col("source_size"))
    s = cut(s, "limits")
    want = float(share) * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # sources below the level give all they may; each round of it raises the level
        shut = F.col("_limit") < level * F.col("_w")
        got = s.agg(F.count_if(shut), F.sum(F.when(shut, F.col("_limit"))), F.sum(F.when(~shut, F.col("_w")))).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], (want - (got[1] or 0.0)) / got[2]
    return s.withColumn("target", F.least(F.col("_limit"), level * F.col("_w"))).drop("_n", "_w", "_limit")


def solve(stats: DataFrame, goals: DataFrame, cap: float = CAP, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """Duals lambda of goals (source, source_size, target) over stats (source, x, words).

    A dual beyond log(cap) / (smallest x of its source) changes no rate, so steps stop there; a step that would leave
    the bounds known so far halves them, or doubles the way down where there is no lower bound yet.
    """
    most = stats.where("x > 0 and words > 0").groupBy(F.col("source").alias("_t")).agg((F.log(F.lit(float(cap))) / F.min("x")).alias("_high"), F.sum("words").alias("_all"))
    state = goals.join(most, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    top = F.col("target") >= cap * F.col("_all") * (1 - 1e-12)
    state = state.withColumn("lambda", F.when(top, F.col("_high")).otherwise(F.lit(0.0)))
    state = state.withColumn("_low", F.lit(None).cast("double")).withColumn("_done", top | F.col("_all").isNull() | (F.col("target") <= 0))
    state = cut(state, "duals")
    lam = F.col("lambda")
    for _ in range(rounds):
        if state.where("not _done").isEmpty():
            break
        open_ = state.where("not _done").select(F.col("source").alias("_s"), lam)
        joined = stats.join(open_, F.col("source").eqNullSafe(F.col("_s")))
        rate = F.exp(F.least(lam * F.col("x"), F.lit(50.0)))
        sums = joined.groupBy("_s").agg(
            F.sum(F.col("words") * F.least(F.lit(float(cap)), rate)).alias("_got"),
            F.sum(F.when(rate <= cap * (1 + 1e-9), F.col("words") * F.col("x") * rate).otherwise(0.0)).alias("_slope"),
        )
        state = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        short = F.col("_got") < F.col("target")
        state = state.withColumn("_low", F.when(short, F.greatest("_low", lam)).otherwise(F.col("_low"))).withColumn("_high", F.when(short, F.col("_high")).otherwise(F.least("_high", lam)))
        newton = F.when((F.col("_slope") > 0) & (F.col("_got") > 0), lam - F.log(F.col("_got") / F.col("target")) * F.col("_got") / F.col("_slope"))
        inside = newton.isNotNull() & (newton < F.col("_high")) & (F.col("_low").isNull() | (newton > F.col("_low")))
        halved = F.when(F.col("_low").isNotNull(), (F.col("_low") + F.col("_high")) / 2).otherwise(lam - 1 - F.abs(lam))
        met = F.abs(F.col("_got") - F.col("target")) <= tolerance * F.greatest(F.lit(1.0), F.col("target"))
        done = F.col("_done") | met | (F.col("_high") - F.col("_low") <= 1e-12 * F.abs(lam))
        state = state.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("lambda", F.when(F.col("_done"), lam).when(inside, newton).otherwise(halved))
        state = cut(state.select(*goals.columns, "_all", "_high", "lambda", "_low", "_done"), "duals")
    else:
        raise RuntimeError("duals did not settle")
    # sums of doubles may differ in their last digits from run to run
    return state.select(*goals.columns, F.round("lambda", 8).alias("lambda"))


def mix(docs: DataFrame, tilt: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, rate, copies, taken.

    Columns of docs that bear one of these names, or begin with mix_, are replaced.
    """
    sized = docs.withColumn("size", size_of(F.col("text"))).withColumn("mix_h", F.xxhash64("doc_id", "text"))
    sized = sized.withColumn("mix_x", (F.col("size") if tilt is None else tilt).cast("double"))
    stats = cut(sized.groupBy("source", F.col("mix_x").alias("x")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "sizes")
    sources = stats.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("mix_n"))
    unit = F.col("source_size") / F.col("mix_n") if tilt is None else F.lit(1.0)
    sources = sources.withColumn("mix_unit", F.when(unit > 0, unit).otherwise(F.lit(1.0)))
    own_unit = sources.select(F.col("source").alias("_u"), "mix_unit")
    scaled = stats.join(own_unit, F.col("source").eqNullSafe(F.col("_u"))).select("source", (F.col("x") / F.col("mix_unit")).alias("x"), "words")
    duals = solve(scaled, targets(sources, weights, share, cap), cap).withColumnRenamed("source", "mix_s")
    keep = [c for c in sized.columns if c not in ("source_size", "target", "rate", "copies", "taken", "mix_n", "mix_unit", "lambda")]
    d = sized.select(*keep).join(duals, F.col("source").eqNullSafe(F.col("mix_s")))
    d = d.withColumn("rate", F.least(F.lit(float(cap)), F.exp(F.least(F.col("lambda") * F.col("mix_x") / F.col("mix_unit"), F.lit(50.0)))))
    # rows repeated beyond a bucket's size are told apart by their place, which changes no bucket's content
    often = cut(sized.groupBy("mix_h").count().where(F.col("count") > BUCKET).select(F.col("mix_h").alias("mix_o")), "repeated")
    place = F.col("mix_h")
    if not often.isEmpty():
        d = d.withColumn("mix_p", F.monotonically_increasing_id()).join(often, F.col("mix_h") == F.col("mix_o"), "left")
        place = F.when(F.col("mix_o").isNull(), F.col("mix_h")).otherwise(F.xxhash64("mix_p"))
    # blank documents take no words; theirs are buckets of one row each
    d = d.withColumn("mix_b", F.when(F.col("size") > 0, F.pmod(place, F.ceil(F.col("mix_n") / BUCKET).cast("long"))).otherwise(-1 - F.pmod(F.col("mix_h"), F.lit(1 << 40))))
    bucket = Window.partitionBy("source", "mix_b")
    order = bucket.orderBy(F.col("size").desc(), "mix_h", "doc_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = 0.1 + 0.8 * F.pmod(F.xxhash64("source", "mix_b"), F.lit(1000)) / 1000.0
    d = d.withColumn("mix_r", F.floor(F.sum("rate").over(upto) + start))
    d = d.withColumn("copies", F.col("mix_r") - F.coalesce(F.lag("mix_r").over(order), F.lit(0)))
    d = d.withColumn("copies", F.least(F.col("copies"), F.lit(cap)).cast("long"))
    d = d.withColumn("mix_goal", F.round(F.sum(F.col("rate") * F.col("size")).over(whole)).cast("long"))
    for _ in range(FILLS):
        d = d.withColumn("mix_gap", F.col("mix_goal") - F.sum(F.col("copies") * F.col("size")).over(whole))
        free = F.when(F.col("mix_gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        fits = free & (F.col("size") > 0) & (F.col("size") <= F.abs("mix_gap"))
        d = d.withColumn("mix_fit", fits).withColumn("mix_sum", F.sum(F.when(F.col("mix_fit"), F.col("size")).otherwise(0)).over(upto))
        d = d.withColumn("copies", F.col("copies") + F.when(F.col("mix_fit") & (F.col("mix_sum") <= F.abs("mix_gap")), F.signum("mix_gap").cast("long")).otherwise(0))
    d = d.withColumn("taken", F.col("copies") * F.col("size"))
    d = d.withColumn("mix_gap", F.col("mix_goal") - F.sum("taken").over(whole))
    d = d.withColumn("mix_room", F.when(F.col("mix_gap") > 0, cap * F.col("size") - F.col("taken")).otherwise(F.col("taken")))
    # from the smallest on: what the rows after this one leave open
    left = F.abs("mix_gap") - (F.sum("mix_room").over(whole) - F.sum("mix_room").over(upto))
    change = F.greatest(F.lit(0), F.least(left, F.col("mix_room")))
    d = d.withColumn("taken", F.col("taken") + F.signum("mix_gap").cast("long") * change)
    return d.select(*[c for c in d.columns if not c.startswith("mix_") and c != "lambda"])


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: whole copies of each document, then a partial copy of its first words."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.col("copies"))
    part = F.when(F.col("size") > 0, F.col("taken") % F.greatest("size", F.lit(1))).otherwise(0)
    n = (whole + (part > 0).cast("int")).cast("int")
    d = mixed.withColumn("_whole", whole.cast("int")).withColumn("_part", part.cast("int")).withColumn("_n", n)
    d = d.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rest = F.element_at(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", F.col("_part") + 1), -1)
    first = F.expr("substring(text, 1, length(text) - length(_rest))")
    d = d.withColumn("_cut", F.col("_k") > F.col("_whole")).withColumn("_rest", F.when(F.col("_cut"), rest))
    d = d.withColumn("text", F.when(F.col("_cut"), first).otherwise(F.col("text")))
    if "n_chars" in columns:
        d = d.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*columns)
