"""A Merkle manifest of a table: a tree of digests for each source, a tree over the sources, and a proof for each row.

Nodes are written once, in blocks of SPAN ** TIER neighbours with all levels between them. Proofs come by coordinates: a
row's index and the size of its group say which siblings (level, position) its proof needs; these coordinates are
exploded and joined with the node table, and what they find is put in order, concatenated and folded. Levels above a block
are looked up once for the block, not for each of its rows, so that no coordinate is asked for by more rows than a block
holds, however large a source is.

Defined cases: a null is written `-`, an empty text `0:`; rows that repeat an id are ordered by id and then by leaf, equal
rows are leaves of their own; a null source is a source of its own and comes first; a null id comes first in its source and is never
tampered with; texts are hashed whole, whatever their length; an empty table gives no rows and no root; columns that are not
asked for, whatever their names, are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.cuts import cut
from dossier.llm.ranks import ranked

SPAN = 3  # children of a node
TIER = 6  # levels in a block
BLOCK = SPAN**TIER

EMPTY_STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def source_key(source: Column) -> Column:
    """Sorts as the source does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _power(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(SPAN**k) for k in range(TIER + 1)]), level.cast("int") + 1)


def _tier_levels(width: Column) -> Column:
    """How many levels a group of this many nodes climbs within one tier."""
    return sum(((width > SPAN**k).cast("int") for k in range(TIER)), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1 as an array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _climb(entries: DataFrame) -> DataFrame:
    """entries (g, idx, digest, width) as written blocks (g, block, width, levels): the nodes of up to TIER levels."""
    blocks = (
        entries.groupBy("g", F.expr(f"idx div {BLOCK}").alias("block"))
        .agg(F.max("width").alias("width"), F.sort_array(F.collect_list(F.struct(F.expr(f"cast(idx % {BLOCK} as int)").alias("pos"), "digest"))).alias("nodes"))
        .withColumn("nodes", F.transform("nodes", lambda x: x["digest"]))
    )

    def above(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        parents = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / SPAN).cast("int"))
        return F.array_append(levels, F.transform(parents, lambda j: F.sha2(F.array_join(F.slice(last, j * SPAN + 1, SPAN), ""), 256)))

    return cut(blocks.withColumn("levels", F.aggregate(_upto(_tier_levels(F.col("width"))), F.array("nodes"), above)).drop("nodes"), "nodes")


def _above(blocks: DataFrame) -> DataFrame:
    """The entries of the tier above written blocks."""
    top = F.element_at(F.element_at("levels", -1), 1)
    return blocks.select("g", F.col("block").alias("idx"), top.alias("digest"), F.ceil(F.col("width") / BLOCK).cast("bigint").alias("width"))


def _node_table(blocks: DataFrame) -> DataFrame:
    levels = blocks.select("g", "block", F.posexplode("levels").alias("level", "row"))
    return levels.select("g", "block", "level", F.posexplode("row").alias("pos", "digest")).withColumn("digest", F.unhex("digest"))


def _siblings(pos: Column, held: Column, levels: Column) -> Column:
    """Coordinates of the siblings that a proof needs: of each level, the others of the run of SPAN that holds the node."""

    def of(level: Column) -> Column:
        own = F.floor(pos / _power(level)).cast("int")
        nodes = F.ceil(held / _power(level)).cast("int")
        run = own - own % SPAN
        others = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda k: run + k), lambda p: (p != own) & (p < nodes))
        return F.transform(others, lambda p: F.struct(level.alias("level"), p.alias("pos")))

    return F.flatten(F.transform(_upto(levels), of))


def _steps(pos: Column, levels: Column, found: Column) -> Column:
    """A proof's levels in order: what stands left and right of the node when its run is concatenated."""

    def of(level: Column) -> Column:
        own = F.floor(pos / _power(level)).cast("int")
        side = lambda keep: F.array_join(F.transform(F.filter(found, lambda s: (s["level"] == level) & keep(s["pos"], own)), lambda s: F.lower(F.hex(s["digest"]))), "")
        return F.struct(side(lambda p, o: p < o).alias("left"), side(lambda p, o: p > o).alias("right"))

    return F.transform(_upto(levels), of)


def _descend(entries: DataFrame, blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """entries (g, idx, width, carried) with steps, their proof's levels in this tier and all above, and what `above` has of their block.

    above: (g, idx, steps, ...) of the blocks, idx being the block.
    """
    of = entries.select("g", F.expr(f"idx div {BLOCK}").alias("block"), F.expr(f"cast(idx % {BLOCK} as int)").alias("own"), "width", *carried)
    of = of.withColumn("levels", _tier_levels(F.col("width"))).withColumn("held", F.least(F.lit(BLOCK), F.col("width") - F.col("block") * BLOCK))
    asked = of.select("g", "block", "own", F.explode(_siblings(F.col("own"), F.col("held"), F.col("levels"))).alias("at")).select("g", "block", "own", "at.*")
    found = asked.join(_node_table(blocks), ["g", "block", "level", "pos"]).select("g", "block", "own", F.struct("level", "pos", "digest").alias("sibling"))
    rows = found.unionByName(of.select("g", "block", "own", F.struct("levels", *carried).alias("entry")), allowMissingColumns=True)
    proofs = (
        rows.repartition("g", "block")
        .groupBy("g", "block", "own")
        .agg(F.sort_array(F.collect_list("sibling")).alias("found"), F.first("entry", ignorenulls=True).alias("entry"))
        .select("g", "block", "own", "entry.*", "found")
    )
    own = _steps(F.col("own"), F.col("levels"), F.col("found"))
    more = above.withColumnsRenamed({"idx": "block", "steps": "_upper"})
    joined = proofs.withColumn("steps", own).drop("found", "levels").join(more, ["g", "block"])
    return joined.withColumn("steps", F.concat("steps", "_upper")).withColumn("idx", F.col("block") * BLOCK + F.col("own")).drop("_upper", "block", "own")


def _tiers(entries: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The tiers of entries and their blocks, lowest first, and one entry (g, idx 0, digest) for each group: its root."""
    widest = entries.agg(F.max("width")).first()[0] or 0
    tiers = []
    while widest > 1 or not tiers:
        blocks = _climb(entries)
        tiers.append((entries, blocks))
        entries, widest = _above(blocks), -(-widest // BLOCK)
    return tiers, entries


def manifest(rows: DataFrame) -> DataFrame:
    """rows (source, id, leaf and others) with subroot, root and steps: the proof's levels from leaf to root.

    source is a key that is not null and sorts as sources do; leaf is a digest. A row's position in its source is that by id and leaf.
    """
    carried = [c for c in rows.columns if c != "source"]
    # written, as dealing by ranges reads its input twice: texts are hashed once
    leaves = ranked(cut(rows.withColumnRenamed("source", "g"), "leaves"), ["g"], ["id", "leaf"], "idx", "width").withColumn("digest", F.col("leaf"))
    leaves = leaves.select("g", "idx", "width", "digest", *carried)
    tiers, subroots = _tiers(leaves.select("g", "idx", "digest", "width"))
    sources = cut(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("digest")), ["g"], ["source"], "idx", "width"), "sources")
    upper, top = _tiers(sources.select("g", "idx", "digest", "width"))

    info = top.select("g", "idx", F.array().cast(EMPTY_STEPS).alias("steps"), F.col("digest").alias("root"))
    for level, (entries, blocks) in reversed(list(enumerate(upper))):
        lowest = sources if level == 0 else entries
        info = _descend(lowest, blocks, info, ["source", "digest"] if level == 0 else [])
    info = cut(info.select(F.col("source").alias("g"), F.lit(0).cast("bigint").alias("idx"), "steps", F.col("digest").alias("subroot"), "root"), "proofs")
    for level, (entries, blocks) in reversed(list(enumerate(tiers))):
        info = _descend(leaves if level == 0 else entries, blocks, info, carried if level == 0 else [])
    return info.withColumnRenamed("g", "source").drop("idx")


def proof(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
