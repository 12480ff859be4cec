"""Cross-sections: statistics, ranks and quantiles inside (date[, sector]) groups.

Unlike a symbol's history, a date can hold any share of the rows, so no function here ever has a group in one task, but for groups
that were counted before and hold at most as many rows as the caller allows.
Statistics are pre-aggregated map-side and joined back. Ranks depend on values alone: distinct values are counted first and
their running counts are built from slices of the value range. Exact positions, whose order ends in a unique key, come from a
range-partitioned order of the whole table.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import col
from panelspark.session import cut_lineage

#: Slices of the value range per octave.
SLICES = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi join in which null keys match, keeping one copy of the keys."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = functools.reduce(
        operator.and_, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    )
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def with_group_stats(df: DataFrame, keys, stats: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row. ``stats`` maps an output name to an aggregate."""
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return null_safe_join(df, table, keys)


def with_row_index(df: DataFrame, keys, order, out: str, size: str | None = None) -> DataFrame:
    """Exact 1-based position of each row in its group under ``order``, and with ``size`` the number of the group's rows.

    A range partitioning on the keys and the order columns cuts hot groups, and long runs of equal values when ``order`` ends in a
    unique key, into many tasks. Each task's rows are sorted and numbered as they stand; a small table of where the groups start
    in each task supplies the offsets.
    """
    order = [col(o) for o in order]
    by = [*[F.col(k) for k in keys], *order]
    placed = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__slice", F.shiftright("__at", 33))
    starts = placed.groupBy("__slice", *keys).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = [F.sum("__n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    starts = cut_lineage(starts.select("__slice", *keys, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__start") + 1).alias("__shift"), *sizes))
    numbered = null_safe_join(placed, F.broadcast(starts) if starts.count() <= BROADCAST_GROUPS else starts, ["__slice", *keys])
    return numbered.withColumn(out, (F.col("__at") + F.col("__shift")).cast("int")).drop("__slice", "__at", "__shift")


def _slice(x: Column) -> Column:
    """A number that never falls as ``x`` rises and cuts each octave of its size into :data:`SLICES` slices."""
    return F.floor(F.signum(x) * F.log2(F.abs(x) * 1e9 + 1.0) * SLICES)


def _running_counts(rows: DataFrame, keys, value: str) -> DataFrame:
    """Distinct non-null values of each group with ``__ties`` rows of that value and ``__below`` rows of smaller ones.

    A frequent value is one row after the first aggregate, so a slice holds few rows however the values are spread.
    """
    x = F.col(value).cast("double")
    counted = rows.filter(x.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__ties")).withColumn("__slice", _slice(x))
    slices = counted.groupBy(*keys, "__slice").agg(F.sum("__ties").alias("__n"))
    lower = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "__slice", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__inside", F.coalesce(F.sum("__ties").over(inside), F.lit(0)))
    joined = null_safe_join(counted, slices, [*keys, "__slice"])
    return joined.select(*keys, value, "__ties", (F.col("__before") + F.col("__inside")).alias("__below"))


def with_average_ranks(df: DataFrame, keys, ranks: dict[str, tuple[str, bool]], tie_break=("symbol",), stored: bool = False) -> DataFrame:
    """Rank of each value in its group with ties averaged; null values stay unranked.

    ``ranks`` maps an output name to ``(value column, ascending)``. All ranks of a frame are found in one pass over
    (name, value) pairs; ``keys`` and ``tie_break`` together identify a row. ``stored`` says that ``df`` is stored already.
    """
    return _average_ranks(df if stored else cut_lineage(df), keys, ranks, tie_break)  # read several times below


#: Up to so many ranked columns, each one's running counts are joined to the rows; more are ranked together as (name, value) pairs.
JOINED_RANKS = 3


def _average_ranks(df: DataFrame, keys, ranks, tie_break) -> DataFrame:
    if len({value for value, _ in ranks.values()}) <= JOINED_RANKS:
        return _joined_ranks(df, keys, ranks)
    row_keys = [*keys, *[t for t in tie_break if t not in keys]]
    values = list(dict.fromkeys(value for value, _ in ranks.values()))
    pairs = F.array(*[F.struct(F.lit(n).alias("__name"), F.col(v).cast("double").alias("__value")) for n, v in enumerate(values)])
    long = df.select(*row_keys, F.explode(F.filter(pairs, lambda p: p["__value"].isNotNull())).alias("__p")).select(*row_keys, "__p.*")
    names = [*keys, "__name"]
    counts = _running_counts(long, names, "__value")
    total = counts.groupBy(*names).agg(F.sum("__ties").alias("__n"))
    counts = null_safe_join(counts, total, names)
    placed = null_safe_join(long, counts, [*names, "__value"])
    up = F.col("__below") + (F.col("__ties") + 1) / 2.0
    wide = []
    for name, (value, ascending) in ranks.items():
        rank = up if ascending else F.col("__n") + 1 - up
        wide.append(F.max(F.when(F.col("__name") == values.index(value), rank)).alias(name))
    return null_safe_join(df, placed.groupBy(*row_keys).agg(*wide), row_keys)


def _joined_ranks(df: DataFrame, keys, ranks) -> DataFrame:
    for value in dict.fromkeys(value for value, _ in ranks.values()):
        exact = df.select(*keys, F.col(value).cast("double").alias("__value"))
        counts = _running_counts(exact, keys, "__value")
        total = counts.groupBy(*keys).agg(F.sum("__ties").alias("__n"))
        counts = null_safe_join(counts, total, keys)
        df = null_safe_join(df.withColumn("__value", F.col(value).cast("double")), counts, [*keys, "__value"])
        up = F.col("__below") + (F.col("__ties") + 1) / 2.0
        mine = {name: up if ascending else F.col("__n") + 1 - up for name, (v, ascending) in ranks.items() if v == value}
        df = df.withColumns({name: F.when(F.col("__value").isNotNull(), rank) for name, rank in mine.items()}).drop("__value", "__ties", "__below", "__n")
    return df


def with_ends(df: DataFrame, keys, value: str, lowest: Column, highest: Column, tie: str = "symbol", stored: bool = False) -> DataFrame:
    """Only the rows at either end of their group by ``value``, with booleans ``__low`` and ``__high``.

    ``lowest`` and ``highest`` are how many rows of the group to take, in terms of its size ``__n``; among equal values the first by
    ``tie`` are taken. Counts per slice of the value range tell in which slice either end stops; only rows of those slices are put
    in order, in a task each where the slice was counted to hold at most :data:`WHOLE` rows. ``stored`` says that reading ``df``
    twice costs less than storing it.
    """
    df = df if stored else cut_lineage(df)
    rows = df.filter(F.col(value).isNotNull()).withColumn("__slice", _slice(F.col(value).cast("double")))
    ends = cut_lineage(_end_slices(rows, keys, lowest, highest))
    groups, most = ends.agg(F.count("*"), F.max(F.greatest("__low_edge", "__high_edge"))).first()
    known = F.broadcast(ends) if groups <= BROADCAST_GROUPS else ends
    met = null_safe_join(rows, known, keys, "inner")
    at_low, at_high = F.col("__slice") == F.col("__low_slice"), F.col("__slice") == F.col("__high_slice")
    split = {"low": at_low & (F.col("__low_edge") > 0), "high": at_high & (F.col("__high_edge") > 0)}
    inside = {"low": F.col("__slice") <= F.col("__low_slice"), "high": F.col("__slice") >= F.col("__high_slice")}
    met = met.withColumns({
        **{f"__{end}": F.coalesce(inside[end] & ~split[end], F.lit(False)) for end in split},
        "__lows": F.when(split["low"], F.col("__low_left")).otherwise(0), "__highs": F.when(split["high"], F.col("__high_left")).otherwise(0)})
    columns = [*df.columns, "__n", "__low", "__high"]
    met = cut_lineage(met.filter("__low or __high or __lows > 0 or __highs > 0").select(*columns, "__slice", "__lows", "__highs"))
    edge = met.filter("__lows > 0 or __highs > 0")
    edge = _ends_in_tasks(edge, keys, value, tie) if (most or 0) <= WHOLE else _ends_by_counts(edge, keys, value, tie)
    whole = met.filter("__lows <= 0 and __highs <= 0").select(*columns)
    return whole.unionByName(edge.select(*columns)).filter("__low or __high")


#: A table of so many groups is sent to all tasks.
BROADCAST_GROUPS = 100_000


def _end_slices(rows: DataFrame, keys, lowest: Column, highest: Column) -> DataFrame:
    """Per group its size, the last slice that each end reaches, the places left there and, if not all of its rows are in, their number."""
    counts = rows.groupBy(*keys, "__slice").agg(F.count("*").alias("__ties"))
    lower = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"__below": F.coalesce(F.sum("__ties").over(lower), F.lit(0)), "__n": F.sum("__ties").over(Window.partitionBy(*keys))})
    room = placed.withColumns({"__lows": lowest - F.col("__below"), "__highs": highest - (F.col("__n") - F.col("__below") - F.col("__ties"))})

    def last(end, pick):
        reached = F.when(F.col(f"__{end}s") > 0, F.col("__slice"))
        edge = F.when(F.col(f"__{end}s") < F.col("__ties"), F.col("__ties")).otherwise(0)
        return pick(F.struct("__slice", F.col(f"__{end}s").cast("long").alias("left"), edge.cast("long").alias("edge")), reached).alias(f"__{end}")

    table = room.groupBy(*keys).agg(F.max("__n").alias("__n"), last("low", F.max_by), last("high", F.min_by))
    return table.select(*keys, "__n", *(F.col(f"__{end}")[c].alias(f"__{end}_{c.strip('_')}") for end in ("low", "high") for c in ("__slice", "left", "edge")))


def _ends_in_tasks(edge: DataFrame, keys, value: str, tie: str) -> DataFrame:
    """Rows of slices that an end reaches in part, by windows inside the slices."""
    inside = Window.partitionBy(*keys, "__slice")
    up, down = (F.row_number().over(inside.orderBy(order, F.col(tie))) for order in (F.col(value).asc(), F.col(value).desc()))
    edge = edge.withColumns({"__up": up, "__down": down})
    return edge.withColumns({"__low": F.col("__low") | (F.col("__up") <= F.col("__lows")), "__high": F.col("__high") | (F.col("__down") <= F.col("__highs"))})


def _ends_by_counts(edge: DataFrame, keys, value: str, tie: str) -> DataFrame:
    """As :func:`_ends_in_tasks` for slices of any size: running counts of distinct values tell which values are in, and only rows of
    a value that is partly in are put in order."""
    edge, names = edge.withColumnRenamed("__slice", "__part"), [*keys, "__part"]
    counts = _running_counts(edge, names, value)
    total = counts.groupBy(*names).agg(F.sum("__ties").alias("__all"))
    edge = cut_lineage(null_safe_join(edge, null_safe_join(counts, total, names), [*names, value], "inner").withColumns({
        "__lows": F.col("__lows") - F.col("__below"), "__highs": F.col("__highs") - (F.col("__all") - F.col("__below") - F.col("__ties"))}))
    whole = lambda places: F.col(places) >= F.col("__ties")
    partly = ((F.col("__lows") > 0) & ~whole("__lows")) | ((F.col("__highs") > 0) & ~whole("__highs"))
    if edge.filter(partly).isEmpty():
        edge = edge.withColumn("__turn", F.lit(1))
    else:
        placed = with_row_index(edge.filter(partly), [*names, value], [tie], "__turn")
        edge = edge.filter(~partly).withColumn("__turn", F.lit(1)).unionByName(placed)
    taken = {out: (F.col(places) > 0) & (whole(places) | (F.col("__turn") <= F.col(places))) for out, places in (("__low", "__lows"), ("__high", "__highs"))}
    return edge.withColumns({out: F.col(out) | hit for out, hit in taken.items()})


def with_percent_ranks(
    df: DataFrame,
    keys,
    ranks: dict[str, tuple[str, bool]],
    *,
    flat_value: float | None = None,
    tie_break=("symbol",),
    stats: dict[str, Column] | None = None,
    whole: int = 0,
    within: DataFrame | None = None,
    packed: bool = False,
    only: str | None = None,
    deal: tuple[list[str], DataFrame] | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Average rank divided by the number of non-null values of the group, and group aggregates of ``stats`` beside it.

    With ``flat_value`` set, a group whose values are all equal gets that constant instead. Groups of at most ``whole`` rows go
    through one shuffle and windows inside it, so that no task holds more than that many rows of a group; only larger ones are stored
    and ranked by slices. Groups are counted on ``within``, a frame that holds at least the rows of ``df`` and is cheaper to count.
    Each rank takes a sort of its rows, which is left out where nobody reads the rank; ``packed`` sorts all ranks' values as narrow
    pairs instead, for many ranks that are all read.

    ``only`` names a boolean column: other rows count for ranks and ``stats`` (which then read nothing but keys and ranked values) and
    are left out of the result, so of them only these columns are shuffled.

    ``deal`` names some of the keys and a frame with at least the frame's rows: if their groups there have at most ``whole`` rows, rows
    are dealt by them, and what follows on the same keys finds them so. A caller of that kind says ``dealt``.
    """
    if whole:
        by, rows, large = list(keys), 0, None
        if deal is not None:
            rows, large = _large_groups(deal[1], deal[0], whole)
            by = list(deal[0]) if large is None else by
        if deal is None or large is not None:
            rows, large = _large_groups(df if within is None else within, keys, whole)
        parts = rows * len({value for value, _ in ranks.values()}) // CELLS + 1

        def in_tasks(part):
            if only is not None and not packed:
                read = {*keys, only, *(value for value, _ in ranks.values())}
                part = part.select(*(F.col(c) if c in read else F.when(F.col(only), F.col(c)).alias(c) for c in part.columns))
            part = part if dealt and large is None else part.repartition(parts, *by)
            part = _packed_percent_ranks(part, keys, ranks, flat_value, stats, tie_break) if packed else _windowed_percent_ranks(part, keys, ranks, flat_value, stats)
            return part if only is None else part.filter(only)

        if large is None:
            return in_tasks(df)
        marked = null_safe_join(df, F.broadcast(large), keys)
        small = in_tasks(marked.filter("__large is null").drop("__large"))
        rest = marked.filter("__large").drop("__large")
        return small.unionByName(with_percent_ranks(rest, keys, ranks, flat_value=flat_value, tie_break=tie_break, stats=stats, only=only))
    tmp = {f"__r_{name}": spec for name, spec in ranks.items()}
    df = cut_lineage(df)  # read several times below
    out = _average_ranks(df, keys, tmp, tie_break)
    counts = {}
    for name, (value, _) in ranks.items():
        counts[f"__n_{name}"] = F.count(F.col(value))
        if flat_value is not None:
            counts[f"__lo_{name}"] = F.min(F.col(value))
            counts[f"__hi_{name}"] = F.max(F.col(value))
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in counts.items()])
    out = null_safe_join(out, table, keys)
    cols = {}
    for name, (value, _) in ranks.items():
        pct = F.try_divide(F.col(f"__r_{name}"), F.col(f"__n_{name}"))
        if flat_value is not None:
            flat = F.col(f"__lo_{name}") == F.col(f"__hi_{name}")
            pct = F.when(F.col(value).isNotNull() & flat, F.lit(flat_value)).otherwise(pct)
        cols[name] = pct
    out = out.withColumns(cols).drop(*tmp, *counts)
    out = with_group_stats(out, keys, stats) if stats else out
    return out if only is None else out.filter(only)


#: Callers that rank many columns let groups of so many rows go through one task as they are.
WHOLE = 100_000


#: So many ranked values go to one task together, if no group is larger.
CELLS = 500_000


def _large_groups(df: DataFrame, keys, whole: int) -> tuple[int, DataFrame | None]:
    """Rows of ``df``, and groups of more than ``whole`` rows, marked ``__large``: at most rows divided by ``whole``. None without any."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) <= whole:
        return rows or 0, None
    return rows, cut_lineage(counts.filter(F.col("__n") > whole).select(*keys, F.lit(True).alias("__large")))


def _packed_percent_ranks(df: DataFrame, keys, ranks, flat_value, stats, tie_break) -> DataFrame:
    """Percent ranks and aggregates of groups that lie in one task each, which sorts its (name, value) pairs.

    Of a row's pairs the first carries its other columns, so the ranks come back without a join or another shuffle.
    """
    columns = list(dict.fromkeys([*df.columns, *ranks, *(stats or {})]))
    row_keys = [*keys, *[t for t in tie_break if t not in keys]]
    rest = [c for c in df.columns if c not in row_keys]
    values = list(dict.fromkeys(value for value, _ in ranks.values()))
    df = df.withColumns({name: agg.over(Window.partitionBy(*keys)) for name, agg in (stats or {}).items()})
    carried = [*rest, *(stats or ())]
    pairs = F.array(*[F.struct(F.lit(n).alias("__name"), (F.col(v).cast("double") + F.lit(0.0)).alias("__value")) for n, v in enumerate(values)])
    long = df.select(*row_keys, *carried, F.explode(pairs).alias("__p"))
    first = F.col("__p.__name") == 0
    # column by column, so that what nobody reads is not carried
    long = long.select(*row_keys, "__p.*", *[F.when(first, F.col(c)).alias(c) for c in carried])
    group = Window.partitionBy(*keys, "__name")
    order = group.orderBy(F.col("__value").asc_nulls_last())
    ties = F.count("__value").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    long = long.withColumns({
        "__up": F.when(F.col("__value").isNotNull(), F.rank().over(order) + (ties - 1) / 2.0), "__n": F.count("__value").over(group),
        "__flat": F.min("__value").over(group) == F.max("__value").over(group)})
    wide = {}
    for name, (value, ascending) in ranks.items():
        pct = (F.col("__up") if ascending else F.col("__n") + 1 - F.col("__up")) / F.col("__n")
        if flat_value is not None:
            pct = F.when(F.col("__flat") & F.col("__up").isNotNull(), F.lit(flat_value)).otherwise(pct)
        wide[name] = F.max(F.when((F.col("__name") == values.index(value)) & (F.col("__n") > 0), pct))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in carried if c not in ranks]
    return long.groupBy(*row_keys).agg(*kept, *[c.alias(name) for name, c in wide.items()]).select(*columns)


def _windowed_percent_ranks(df: DataFrame, keys, ranks, flat_value, stats) -> DataFrame:
    """Percent ranks and aggregates of groups that lie in one task each, with a sort per ranked column."""
    group, columns = Window.partitionBy(*keys), list(dict.fromkeys([*df.columns, *ranks, *(stats or {})]))
    values = {value: f"__x{n}" for n, value in enumerate(dict.fromkeys(value for value, _ in ranks.values()))}
    df = df.withColumns({x: F.col(value).cast("double") + F.lit(0.0) for value, x in values.items()})  # one zero
    cols = {}
    for x in values.values():
        order = group.orderBy(F.col(x).asc_nulls_last())
        ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        cols[f"{x}_up"] = F.rank().over(order) + (ties - 1) / 2.0
        cols[f"{x}_n"] = F.count(x).over(group)
        if flat_value is not None:
            cols[f"{x}_flat"] = F.min(x).over(group) == F.max(x).over(group)
    df = df.withColumns({**cols, **{name: agg.over(group) for name, agg in (stats or {}).items()}})
    out = {}
    for name, (value, ascending) in ranks.items():
        x = values[value]
        up, n = F.col(f"{x}_up"), F.col(f"{x}_n")
        pct = (up if ascending else n + 1 - up) / n
        if flat_value is not None:
            pct = F.when(F.col(f"{x}_flat"), F.lit(flat_value)).otherwise(pct)
        out[name] = F.when(F.col(x).isNotNull(), pct)
    return df.withColumns(out).select(*columns)


def with_quantile_bucket(df: DataFrame, keys, value: str, out: str, buckets: int = 10, tie_break=("symbol",)) -> DataFrame:
    """Equal-frequency bucket 1..n of the row position, right-closed like a quantile cut."""
    rows = df.filter(F.col(value).isNotNull())
    placed = with_row_index(rows, keys, [F.col(value).asc(), *tie_break], "__pos", "__n")
    spread = F.try_divide((F.col("__pos") - 1) * F.lit(float(buckets)), F.col("__n") - 1)
    bucket = F.greatest(F.lit(1), F.ceil(F.coalesce(spread, F.lit(0.0)))).cast("int")
    return placed.withColumn(out, bucket).drop("__pos", "__n")


def group_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float], tie_break=("symbol",)) -> DataFrame:
    """Exact linearly interpolated quantiles per group, read from the running counts of its distinct values."""
    counts = _running_counts(df, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("__ties").alias("__n"))
    counts = null_safe_join(counts, total, keys)
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("__n") - 1) * F.lit(q)  # from 0

        def held(position):
            here = (F.col("__below") < position) & (position <= F.col("__below") + F.col("__ties"))
            return F.max(F.when(here, F.col(value)))

        low, high, part = held(F.floor(at) + 1), held(F.ceil(at) + 1), F.max(at - F.floor(at))
        aggs.append((low * (1 - part) + high * part).alias(name))
    return counts.groupBy(*keys).agg(*aggs)
