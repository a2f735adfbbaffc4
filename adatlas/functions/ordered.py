"""Row numbers, ranks and previous values within keys of any size.

A window over a key sorts all its rows in one task. Here rows are range-partitioned by key and order, so that a hot key
lies in as many parts as its rows ask for. Within a part a window serves each key; from part to part only one row for
each key and part is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.sources.shared import written

#: monotonically_increasing_id counts the rows of a partition in its low bits.
ROW_BITS = 33


#: A column and whether it falls.
Order = tuple[Column, bool]


def in_order(df: DataFrame, keys: list[str], order: list[Order], ties: list[Order] = (), number: str | None = None, rank: str | None = None, lag: dict[str, str] | None = None, lead: dict[str, str] | None = None, most: dict[str, str] | None = None) -> DataFrame:
    """Adds the row number from 1 within the keys (`number`), the rank by `order` alone (`rank`, equal for equal order),
    values of the row before (`lag`: new name to column; null for a first row) and of the row after (`lead`), and the
    greatest value among all rows before (`most`).

    Rows stand in `order`, then in `ties`; nulls come first where a column rises and last where it falls, as in a
    window. Null keys are keys. Among rows that are equal in all of these any comes first. An empty table gives an
    empty result.
    """
    lag, lead, most = lag or {}, lead or {}, most or {}
    by, rest = [f"__o{k}" for k in range(len(order))], [f"__t{k}" for k in range(len(ties))]
    own = df.withColumns({name: c for name, (c, _) in zip(by + rest, [*order, *ties])})
    sort = [F.asc(k) for k in keys] + [F.desc(c) if falls else F.asc(c) for c, (_, falls) in zip(by + rest, [*order, *ties])]
    own = own.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id())
    own = written(own, "in-order").withColumn("__part", F.shiftright("__id", ROW_BITS))
    in_part, value = W.partitionBy(*keys, "__part").orderBy("__id"), F.struct(*by, F.lit(0).alias("__0"))
    own = own.withColumns({"__n": F.row_number().over(in_part), **{f"__lag_{a}": F.lag(c).over(in_part) for a, c in lag.items()}, **{f"__lead_{a}": F.lead(c).over(in_part) for a, c in lead.items()}, **{f"__most_{a}": F.max(c).over(in_part.rowsBetween(W.unboundedPreceding, -1)) for a, c in most.items()}})
    if rank:
        own = own.withColumn("__run", F.min("__n").over(W.partitionBy(*keys, "__part", *by)))
    last, first = (lambda c: F.max_by(c, "__id")), (lambda c: F.min_by(c, "__id"))
    spans = own.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"), first(value).alias("__low"), last(value).alias("__high"), (last("__run") if rank else F.lit(1)).alias("__start"), *[last(c).alias(f"__last_{a}") for a, c in lag.items()], *[first(c).alias(f"__first_{a}") for a, c in lead.items()], *[F.max(c).alias(f"__high_{a}") for a, c in most.items()])
    parts = W.partitionBy(*keys).orderBy("__part")
    spans = spans.withColumns({"__before": F.sum("__rows").over(parts) - F.col("__rows"), "__was": F.lag("__high").over(parts), **{f"__carry_{a}": F.lag(f"__last_{a}").over(parts) for a in lag}, **{f"__next_{a}": F.lead(f"__first_{a}").over(parts) for a in lead}, **{f"__upto_{a}": F.max(f"__high_{a}").over(parts.rowsBetween(W.unboundedPreceding, -1)) for a in most}, "__after": F.lead("__rows").over(parts)})
    # where the run of equal order at a span's end began: in an earlier span, if all of this one goes on with it
    goes_on = F.col("__was").isNotNull() & F.col("__was").eqNullSafe(F.col("__low"))
    begun = F.last(F.when(~(goes_on & F.col("__low").eqNullSafe(F.col("__high"))), F.col("__before") + F.col("__start")), ignorenulls=True).over(parts)
    spans = spans.withColumn("__begun", begun)
    spans = spans.withColumns({"__open": F.when(goes_on, F.lag("__begun").over(parts)), "__going": F.when(goes_on, F.col("__low"))})
    # a key comes from an earlier part, or goes on in a later one, at most once in each part: no more rows than twice the parts
    carried = spans.where("__before > 0 or __after is not null").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), "__before", "__open", "__going", "__rows", *[f"__carry_{a}" for a in lag], *[f"__next_{a}" for a in lead], *[f"__upto_{a}" for a in most])
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = own.join(F.broadcast(carried), same, "left")
    before = F.coalesce("__before", F.lit(0))
    made = {a: F.when((F.col("__n") == 1) & F.col("__of").isNotNull(), F.col(f"__carry_{a}")).otherwise(F.col(f"__lag_{a}")) for a in lag}
    made |= {a: F.when(F.col("__n") == F.col("__rows"), F.col(f"__next_{a}")).otherwise(F.col(f"__lead_{a}")) for a in lead}
    made |= {a: F.greatest(f"__most_{a}", f"__upto_{a}") for a in most}
    if number:
        made[number] = F.col("__n") + before
    if rank:
        made[rank] = F.when(F.col("__open").isNotNull() & value.eqNullSafe(F.col("__going")), F.col("__open")).otherwise(F.col("__run") + before)
    return out.select(*[c for c in df.columns if c not in made], *[c.alias(a) for a, c in made.items()])
