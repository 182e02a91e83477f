"""Mixing sources to target weights by entropy balancing [native].

Every document gets a rate between 0 and 2. Among all rates whose tokens meet the target of each source, those of
least relative entropy against "each of two possible copies is taken with probability 1/2" are an exponential tilt
by document size: rate = 2 / (1 + exp(-lambda * size / mean size)), with one lambda per source. The lambdas minimise
a convex dual; Newton steps over the distributed (source, size) counts find them, kept inside a bracket. The rates are
then rounded into 0, 1 or 2 copies so that the error of a source stays within about one document.

Everything is DataFrame code: scans are reduced to counts of (source, size) before any step, the loop's state is one
row per source, and no source, size or group of copies meets in one task: documents of one size are dealt into
BINS bins by a hash and numbered inside them, and a source's sizes are summed in blocks of SIZE_BLOCK, then over the blocks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0 and its documents rate 1 (nothing is taken from them); a very long text is one large size, so that its source's
error may be as large; documents of one size and source (ties) get their copies in the order of a hash; repeated rows are
rows of their own; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, cut, row_hash

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5  # of all sizes
CAP = 2.0  # times a source's or a document's size
BINS = 1024
TOLERANCE = 1e-10
UNIT = 1 << 20  # of a copy: expected copies are summed as whole numbers of these, so sums do not depend on their order
SIZE_BLOCK = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def with_rank(per_source: DataFrame) -> DataFrame:
    """Adds rank, from 1, by source in code point order, null last.

    Sources are dealt by range; a row's rank is its number within its partition plus the counts of those before it,
    so no task sees all sources.
    """
    spark = per_source.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(per_source.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("nth", F.row_number().over(inside)).join(offsets, "part").withColumn("rank", F.col("offset") + F.col("nth")).drop("part", "nth", "offset")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target: share of all sizes by weight, none above cap times its source's size.

    The excess of capped sources goes to the others by weight until none is above; each round is one aggregate, of
    which the driver sees three numbers.
    """
    ranked = cut(
        with_rank(per_source).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))), "weights"
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        above = F.col("source_size") * cap <= F.col("weight") * F.lit(level)
        held, open_weight = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        new = (total - held * cap) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * cap)).drop("rank", "weight")


def rate(lam: Column, z: Column) -> Column:
    return F.lit(CAP) / (F.lit(1.0) + F.exp(-lam * z))


def solve(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with lambda; classes: source, size, n. Newton steps on the dual of each source, all sources at once, until each
    meets its target: the dual is convex, and a step that leaves its bracket is replaced by the bracket's middle."""
    big = F.lit(float("inf"))
    state = sources.select("*", F.lit(0.0).alias("lam"), (-big).alias("lo"), big.alias("hi"), F.lit(None).cast("double").alias("miss"))
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * CAP)
    c, s = classes.alias("c"), lambda x: x.alias("s")
    while True:
        z = F.col("c.size") * F.col("s.n_docs") / F.col("s.source_size")
        r = rate(F.col("s.lam"), z)
        moments = (
            c.join(s(state.filter(free)), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("msource"))
            .agg(F.sum(F.col("c.n") * F.col("c.size") * r).alias("got"), F.sum(F.col("c.n") * F.col("c.size") * z * r * (1 - r / CAP)).alias("slope"))
        )
        miss = F.col("got") - F.col("target")
        step = F.col("lam") - miss / F.col("slope")
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        inside = (step > lo) & (step < hi) & ~F.isnan(step)
        middle = F.when(lo == -big, hi * 2 - 1).when(hi == big, lo * 2 + 1).otherwise((lo + hi) / 2)
        moved = F.when(inside, step).otherwise(middle)
        # done within the tolerance, or where doubles have no value between the bracket's ends
        near = (F.abs(miss) <= F.lit(TOLERANCE) * F.col("target")) | (moved == F.col("lam"))
        state = cut(
            state.join(moments, F.col("source").eqNullSafe(F.col("msource")), "left").select(
                *sources.columns,
                F.when(F.col("got").isNull() | near, F.col("lam")).otherwise(moved).alias("lam"),
                lo.alias("lo"), hi.alias("hi"),
                F.when(F.col("got").isNull() | near, F.lit(0.0)).otherwise(F.abs(miss)).alias("miss"),
            ),
            "lambda",
        )
        if not state.agg(F.max("miss")).first()[0]:
            break
    # sums of floats depend on their order in the last digits; rounding makes reruns agree
    return state.select(*sources.columns, F.round("lam", 9).alias("lam"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_key: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, row_key, source_size, target, rate, copies, taken.

    row_key is a hash of id, source and text unless given.
    """
    key = F.xxhash64(id_col, F.col(source_col).cast("string"), text_col) if row_key is None else row_key
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
            key.alias("row_key"),
        ),
        "sizes",
    )
    classes = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sources = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")))
    solved = solve(classes, sources)

    z = F.col("c.size") * F.col("s.n_docs") / F.col("s.source_size")
    expected = (
        classes.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .select(
            "c.*", "s.source_size", "s.target",
            F.when(F.col("s.source_size") == 0, F.lit(1.0)).when(F.col("s.target") >= F.col("s.source_size") * CAP, F.lit(CAP)).otherwise(rate(F.col("s.lam"), z)).alias("rate"),
        )
    )
    # running sums in order of size: what rounding moves goes to the next size, so the error stays within one document
    expected = expected.withColumns({"units": F.round(F.col("n") * F.col("rate") * UNIT).cast("bigint"), "block": F.expr(f"size div {SIZE_BLOCK}")})
    blocks = expected.groupBy(F.col("source").alias("bsource"), F.col("block").alias("bblock")).agg(F.sum("units").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("bsource").orderBy("bblock").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = expected.join(blocks.withColumn("before", before), F.col("source").eqNullSafe(F.col("bsource")) & (F.col("block") == F.col("bblock")))
    upto = F.col("before") + F.sum("units").over(Window.partitionBy("source", "block").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda x: F.floor((x + UNIT // 2) / UNIT).cast("bigint")
    planned = started.withColumn("upto", upto).withColumn("class_copies", whole(F.col("upto")) - whole(F.col("upto") - F.col("units")))

    binned = slim.withColumn("bin", F.pmod(F.xxhash64("row_key", "doc_id"), F.lit(BINS)).cast("int"))
    cells = binned.groupBy("source", "size", "bin").agg(F.count("*").alias("m"))
    in_class = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        cells.alias("b").join(planned.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.size") == F.col("p.size")))
        .select("b.source", "b.size", "b.bin", "b.m", "p.n", "p.class_copies", "p.source_size", "p.target", "p.rate")
        .withColumn("seen", F.sum("m").over(in_class))
        .withColumn("cell_copies", F.expr("(class_copies * seen) div n - (class_copies * (seen - m)) div n"))
    )
    in_cell = Window.partitionBy("d.source", "d.size", "d.bin").orderBy("d.row_key", "d.doc_id")
    on = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.bin") == F.col("c.bin"))
    copies = F.expr("c.cell_copies div c.m") + (F.row_number().over(in_cell) <= F.col("c.cell_copies") % F.col("c.m")).cast("int")
    return binned.alias("d").join(cells.alias("c"), on).select(
        "d.doc_id", "d.source", "d.size", "d.row_key", "c.source_size", "c.target", "c.rate", copies.cast("bigint").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it: the columns of docs, whatever their names.

    Texts are shuffled once, to their row keys; rows equal in all columns share a key and their copies are made of one.
    """
    planned = mix(docs, id_col, text_col, source_col, row_hash(docs)).groupBy(F.col("row_key").alias("plan_key"), "doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    plan = cut(planned.filter("copies > 0"), "plan")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_hash(docs).alias("row_key"))
    on = (F.col("row_key") == F.col("plan_key")) & F.col("id").eqNullSafe(F.col("doc_id"))
    repeated = lambda df: df.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")
    single = repeated(keyed.join(plan.filter("n = 1"), on).select("row", "copies"))
    several = cut(plan.filter("n > 1"), "repeats")
    if several.isEmpty():
        return single
    equal = keyed.join(several, on).groupBy("row_key", "id").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return single.unionByName(repeated(equal))
