"""Mixing series to target weights with a low-discrepancy schedule.

Rows of every entity are shuffled, laid end to end and cut into blocks of equally many units. A schedule of
slots takes blocks in turn: golden-ratio points fall into intervals as wide as the entities' targets, so
every stretch of the mix holds all entities in proportion. The k-th slot of an entity takes its k-th block.

Entities and their ordered rows are those of a panel (`PanelSpec.entity`, position in the series); `size`
counts the units a row brings, for instance the target column or 1 per week. A training set can so be
balanced between large and small series. Documents with a source, an id and a word count fit as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import SPACES, WORD, free_names, null_safe_join, pieces, saved

GOLDEN = 0.6180339887498949
SPACE = r"[\x20\x09-\x0D]"
SLOT_CHUNK = 8192
ROW_CHUNK = 8192
ELEMENT = ["entity", "pos", "size", "copy"]


def entity_targets(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    entity: str = "entity", size: str = "size",
) -> DataFrame:
    """(entity, place, entity_size, target): how many units the mix takes of each entity.

    Entities in order (strings by code point, null last) weigh ``weights`` in turn. Together they take
    ``share`` times all units, by weight, but none more than ``most`` times its own; what that leaves is
    shared among the others by weight. The windows see one row per entity, not its rows.
    """
    totals = rows.groupBy(F.col(entity).alias("entity")).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("entity_size"))
    every = Window.partitionBy(F.lit(0))
    placed = totals.withColumn("place", F.row_number().over(every.orderBy(F.col("entity").asc_nulls_last())) - 1)
    placed = placed.withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ).withColumns({
        "_most": F.col("entity_size") * F.lit(float(most)),
        "_all": F.sum("entity_size").over(every) * F.lit(float(share)),
    })
    filling = every.orderBy(F.col("_most") / F.col("_weight"), "place")
    filled = placed.withColumns({
        "_before": F.coalesce(F.sum("_most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_full", F.col("_most") * F.col("_left") <= (F.col("_all") - F.col("_before")) * F.col("_weight"))
    given = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(every)
    return filled.select(
        "entity", "place", "entity_size",
        F.when(F.col("_full"), F.col("_most"))
        .otherwise(F.col("_weight") * (F.col("_all") - given) / open_weight).alias("target"),
    )


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, place, nth): which entity each slot of the mix serves, and its how-manieth slot that is.

    Slot i stands at the fractional part of i times the golden ratio, in the interval of one entity. An
    entity gets the slots its target needs. Slots beyond are void; if the points left it short by the few
    that their discrepancy allows, the rest follow at the end. Slots meet entities by an equi-join on the
    cells of a grid. Ranks are counted in chunks of slots, so an entity with most slots is spread.
    """
    spark = targets.sparkSession
    needed = targets.select(
        "place", F.ceil(F.round("target").cast("long") / block).cast("long").alias("need")
    ).where("need > 0")
    count, total = needed.agg(F.count(F.lit(1)), F.sum("need")).first()
    total, grid = int(total or 0), 4 * max(1, count)
    upto = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    edges = needed.withColumn("_to", F.sum("need").over(upto) / F.lit(float(max(1, total)))).withColumn(
        "_from", F.coalesce(F.lag("_to").over(Window.partitionBy(F.lit(0)).orderBy("place")), F.lit(0.0))
    )
    cells = edges.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") * grid), F.least(F.floor(F.col("_to") * grid), F.lit(grid - 1))))
    )
    points = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % 1.0).alias("_u"))
    served = (
        points.withColumn("_cell", F.floor(F.col("_u") * grid))
        .join(cells, "_cell")
        .where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
        .select("slot", "place", "need", F.floor(F.col("slot") / SLOT_CHUNK).alias("_chunk"))
    )
    earlier = Window.partitionBy("place").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = served.groupBy("place", "_chunk").agg(F.count(F.lit(1)).alias("_slots"))
    starts = chunks.select("place", "_chunk", F.coalesce(F.sum("_slots").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("place", "_chunk").orderBy("slot")
    ranked = (
        served.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["place", "_chunk"])
        .withColumn("nth", F.col("_start") + F.col("_rank"))
    )
    got = chunks.groupBy("place").agg(F.sum("_slots").alias("_got"))
    late = (
        needed.join(got, "place", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where("_got < need")
        .select("place", F.explode(F.sequence(F.col("_got"), F.col("need") - 1)).alias("nth"), "_got")
        .select((F.lit(total) + (F.col("nth") - F.col("_got")) * F.lit(count) + F.col("place")).alias("slot"), "place", "nth")
    )
    return ranked.where("nth < need").select("slot", "place", "nth").unionByName(late)


def elements(rows: DataFrame, entity: str = "entity", order: str = "pos", size: str = "size") -> DataFrame:
    """(entity, pos, size, copy): the rows to mix, repeated rows told apart by ``copy``; null sizes are 0."""
    counted = rows.groupBy(
        F.col(entity).alias("entity"), F.col(order).alias("pos"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
    ).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.select("entity", "pos", "size", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("copy"))


def _running(df: DataFrame, value: Column, by: Sequence[str], key: str, bits: int, ties: Sequence[str]) -> DataFrame:
    """Add ``_start``: the sum of ``value`` over the rows of the same ``by`` with a smaller hash ``key``.

    The top bits of the hash cut a group into chunks of bounded size, whose sums give each its start.
    """
    cut = df.withColumns({"_v": value, "_part": F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")})
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_part").agg(F.sum("_v").alias("_sum"))
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_run", F.sum("_v").over(inside))
        .join(starts, [*by, "_part"])
        .withColumn("_start", F.col("_base") + F.col("_run") - F.col("_v"))
        .drop("_v", "_part", "_run", "_base")
    )


def mix_entities(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block: int = 1024, seed: int = 0, entity: str = "entity", order: str = "pos", size: str = "size",
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` and the targets it meets.

    The mix has one row per stretch of units it takes: ``slot`` (its place), ``at`` (the place inside the
    slot), the row (``entity``, ``pos``, ``size``, ``copy``), ``pass_no`` and the half-open span
    ``start``, ``stop`` of its units. An entity is read whole before it is read again, in another order;
    it gives its target rounded to whole units, and no row more than ``most`` (rounded up) times.
    The same rows and ``seed`` give the same mix under any partitioning.

    Null entities are one entity; null and zero sizes take no part; repeated rows are taken separately;
    rows of an empty table give an empty mix. Other columns are ignored.
    """
    each = elements(rows, entity, order, size)
    targets = entity_targets(rows, weights, share, most, entity, size)
    passes = max(1, -int(-most // 1))
    count = each.count()
    bits = max(0, pieces(count, ROW_CHUNK).bit_length() - 1 if count > ROW_CHUNK else 0)
    wanted = targets.select("entity", "place", "entity_size", F.round("target").cast("long").alias("_units"))
    placed = null_safe_join(each.where("size > 0"), wanted, ["entity"], "inner")
    read = placed.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where(
        F.col("pass_no") * F.col("entity_size") < F.col("_units")
    ).withColumn("_shuffled", F.xxhash64(F.lit(seed), F.col("pass_no"), F.col("pos"), F.col("size"), F.col("copy")))
    laid = _running(read, F.col("size"), ["place", "pass_no"], "_shuffled", bits, ["pos", "size", "copy"])
    first = F.col("pass_no") * F.col("entity_size") + F.col("_start")
    taken = laid.withColumn("_first", first).withColumn("_last", F.least(first + F.col("size"), F.col("_units"))).where(
        F.col("_first") < F.col("_last")
    )
    blocks = taken.withColumn(
        "nth", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_last") - 1) / block)))
    ).withColumns({
        "_from": F.greatest("_first", F.col("nth") * block),
        "_upto": F.least("_last", (F.col("nth") + 1) * block),
    })
    mixed = blocks.join(schedule(targets, block), ["place", "nth"]).select(
        "slot", (F.col("_from") - F.col("nth") * block).alias("at"), *ELEMENT, "pass_no",
        (F.col("_from") - F.col("_first")).alias("start"), (F.col("_upto") - F.col("_first")).alias("stop"),
    )
    return mixed, targets


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, count: Column) -> Column:
    """``text`` up to the end of its ``count``-th word."""
    rest = F.element_at(F.split(F.concat(F.lit(" "), text), SPACE + "+", (count + 2).cast("int")), -1)
    return F.rtrim(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(rest)), F.lit(SPACES))


def mix_texts(
    df: DataFrame, entity: str = "source", order: str = "doc_id", text: str = "text", slots_per_part: int = 4096, **settings
) -> DataFrame:
    """The rows of ``df`` that a mix of its words takes, as often as it takes them, in mix order within parts.

    Each reading of a row is one row; the one that an entity's target cuts holds its first words only. Rows
    the mix does not reach, and rows without words, are left out. Rows that repeat an entity, order and size meet
    in one task, so ids should be nearly unique. Further ``settings`` are those of `mix_entities`.
    """
    added = ["_mix_row", "_mix_copy", "_mix_size", "_mix_reading", "_mix_readings"]
    free = free_names(df, added, [entity, order, text])
    body, size = F.col(f"`{text}`"), word_count(F.col(f"`{text}`"))
    sizes = saved(
        df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{order}`").alias("pos"), size.alias("size")), "sizes"
    )
    mixed, _ = mix_entities(sizes, **settings)
    readings = (
        mixed.groupBy(*ELEMENT, "pass_no")
        .agg(F.min("slot").alias("slot"), F.sum(F.col("stop") - F.col("start")).alias("words"))
        .groupBy(F.struct(F.col("entity"), F.col("pos"), F.col("size")).alias("_mix_row"))
        .agg(F.collect_list(F.struct("copy", "slot", "words")).alias("_mix_readings"))
    )
    # One struct as the key: it is never null, and numbering, join and texts share one shuffle.
    row = F.struct(F.col(f"`{entity}`").alias("entity"), F.col(f"`{order}`").alias("pos"), F.col("_mix_size").alias("size"))
    same = Window.partitionBy("_mix_row").orderBy(F.xxhash64(body))
    numbered = free.withColumn("_mix_size", size).withColumn("_mix_row", row).withColumn("_mix_copy", F.row_number().over(same) - 1)
    own = F.filter("_mix_readings", lambda r: r["copy"] == F.col("_mix_copy"))
    read = numbered.join(readings, "_mix_row").withColumn("_mix_reading", F.explode(own))
    words = F.col("_mix_reading.words")
    cut = read.withColumn(text, F.when(words < F.col("_mix_size"), first_words(body, words)).otherwise(body))
    parts = F.floor(F.col("_mix_reading.slot") / slots_per_part)
    return (
        cut.withColumn("_mix_copy", parts).repartition("_mix_copy")
        .sortWithinPartitions("_mix_copy", "_mix_reading.slot").drop(*added)
    )
