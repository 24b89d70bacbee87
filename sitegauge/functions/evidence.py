"""The evidence list: ``array<struct<signal, weight, detail>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.schemas import EVIDENCE


def item(signal: Column | str, weight: Column | int, detail: Column) -> Column:
    signal = F.lit(signal) if isinstance(signal, str) else signal
    weight = F.lit(weight) if isinstance(weight, int) else weight
    return F.struct(
        signal.alias("signal"), weight.cast("int").alias("weight"), detail.cast("string").alias("detail")
    )


def item_when(cond: Column, signal: Column | str, weight: Column | int, detail: Column) -> Column:
    return F.when(cond, item(signal, weight, detail))


def evidence(*items: Column) -> Column:
    """List of the items that are not null, in order."""
    if not items:
        return empty()
    return F.array_compact(F.array(*items)).cast(EVIDENCE)


def empty() -> Column:
    return F.array().cast(EVIDENCE)


def or_empty(list_col: Column) -> Column:
    return F.coalesce(list_col, empty())


def total(list_col: Column) -> Column:
    return F.aggregate(or_empty(list_col), F.lit(0), lambda acc, e: acc + F.coalesce(e["weight"], F.lit(0)))


def strongest(list_col: Column) -> Column:
    """Item of the largest weight, the first of equals; null for an empty list."""
    ranked = F.transform(
        list_col, lambda e, i: F.struct(e["weight"].alias("w"), (-i).alias("p"), e.alias("e"))
    )
    return F.array_max(ranked)["e"]


def strongest_counts(list_col: Column) -> Column:
    """The strongest item first with its weight, the others after it with weight 0."""
    ranked = F.transform(
        or_empty(list_col), lambda e, i: F.struct(e["weight"].alias("w"), (-i).alias("p"), e.alias("e"))
    )
    top = F.array_max(ranked)
    rest = F.transform(
        F.filter(ranked, lambda r: r["p"] != top["p"]),
        lambda r: item(r["e"]["signal"], F.lit(0), r["e"]["detail"]),
    )
    return F.when(F.size(ranked) > 0, F.concat(F.array(top["e"]), rest)).otherwise(empty()).cast(EVIDENCE)


def as_text(list_col: Column) -> Column:
    """Entries with a detail, joined by ``; ``, with ``(+w)`` where the weight counts."""
    kept = F.filter(list_col, lambda e: F.coalesce(e["detail"], F.lit("")) != "")
    lines = F.transform(
        kept,
        lambda e: F.when(
            e["weight"] > 0, F.concat(e["detail"], F.lit(" (+"), e["weight"].cast("string"), F.lit(")"))
        ).otherwise(e["detail"]),
    )
    return F.array_join(lines, "; ")
