"""Temperature mixing: source shares to a power, with the power found by bisection, realised as block permutations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitegauge.llm.common import bounded, reliable, with_package
from sitegauge.llm.wordarrays import give_back, text_chunks, words
from sitegauge.operators.ranking import global_running_sum

#: Tokens in a block, the unit that is permuted. Only one block of a source is ever cut.
BLOCK_TOKENS = 1_000_000
#: Powers looked at in one round of the bisection, and rounds: 17 ** 8 steps in all.
_POINTS, _ROUNDS = 16, 8


@F.arrow_udf(T.LongType())
def count_words(text: pa.Array) -> pa.Array:
    parts = [np.diff(words(data, offsets)[2]) for _, _, data, offsets in text_chunks(text)]
    give_back()
    return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))


@dataclass(frozen=True)
class Target:
    """What the mixture must meet. With neither limit the shares stay as they are.

    entropy: least entropy of the weights, as a share of the entropy of equal weights.
    max_repeats: most often that a source may be gone through; binds before the entropy where both can't be met.
    budget: tokens to give out; None: as many as show every source at least once in full.
    """

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | None = None
    seed: int = 17


def _power(totals: DataFrame, target: Target) -> float:
    """The power for the shares: as near to 1 as the entropy allows, but no less than the repetition limit does.

    Sections [0, 1] in rounds; a round is one aggregation over the totals, one row a source, that looks at 16 powers.
    """
    p = F.col("tokens") / F.lit(float(totals.agg(F.sum("tokens")).first()[0] or 1))
    sources = totals.where("tokens > 0").select(p.alias("p"), "tokens").withColumn("lp", F.log("p"))
    n = sources.count()
    if n < 2 or (target.entropy is None and target.max_repeats is None):
        return 1.0

    def section(holds, low: float, high: float) -> float:
        """The place in [low, high] up to which holds(column of facts) stays False."""
        for _ in range(_ROUNDS):
            points = [low + (high - low) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)]
            facts = sources.agg(*[x.alias(f"{k}{i}") for i, a in enumerate(points) for k, x in _facts(a).items()]).first().asDict()
            ok = [holds({k: facts[f"{k}{i}"] for k in ("z", "zl", "least", "most")}, a) for i, a in enumerate(points)]
            first = ok.index(True) if True in ok else _POINTS
            low, high = ([low, *points][first], [*points, high][first])
        return high

    def _facts(a: float) -> dict[str, Column]:
        w = F.exp(F.lit(a) * F.col("lp"))
        per_token = F.exp(F.lit(a - 1.0) * F.col("lp"))
        return {"z": F.sum(w), "zl": F.sum(w * F.col("lp")), "least": F.min(per_token), "most": F.max(per_token)}

    total = totals.agg(F.sum("tokens")).first()[0]

    def too_even(f: dict, a: float) -> bool:
        return np.log(f["z"]) - a * f["zl"] / f["z"] < target.entropy * np.log(n)

    def rare_enough(f: dict, a: float) -> bool:
        budget = target.budget if target.budget is not None else total * f["z"] / f["least"]
        return budget * f["most"] / (f["z"] * total) <= target.max_repeats

    power = 1.0
    if target.entropy is not None:
        power = section(too_even, 0.0, 1.0)
    if target.max_repeats is not None:
        power = max(power, section(rare_enough, 0.0, 1.0))
    # The sums above differ in their last digit with the order of their terms.
    return round(float(power), 9)


def _source(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_source")


def plan(narrow: DataFrame, target: Target) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) for rows (_source, _key, _tokens).

    sources: tokens, power, weight, quota, blocks, full epochs. blocks: one row for each block, with the copies of it
    that are given whole, and `cut`: the tokens still to be taken from it (the last block of the last epoch), or null.
    """
    totals = reliable(narrow.groupBy("_source").agg(F.sum("_tokens").alias("tokens")))
    power = _power(totals, target)
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.exp(F.lit(power) * F.log(F.col("tokens") / F.lit(float(total))))).otherwise(F.lit(0.0))
    weighted = totals.withColumn("raw", raw)
    z, at_least = weighted.agg(F.sum("raw"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw")))).first()
    z = z or 1.0
    budget = target.budget if target.budget is not None else (at_least or 0.0) * z
    quota = F.round(F.col("raw") / F.lit(float(z)) * F.lit(float(budget)))
    sources = reliable(
        weighted.withColumn("power", F.lit(power)).withColumn("weight", F.round(F.col("raw") / F.lit(float(z)), 12)).withColumn("quota", quota.cast("long"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)).cast("long"))
        # A source without a token costs nothing and is given once.
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long"))
        .drop("raw")
    )
    placed = _placed(narrow, sources, target)
    filled = placed.groupBy("_source", "_block", "quota", "epochs", "tokens").agg(F.sum("_tokens").alias("_size"))
    turn = F.xxhash64("_source", "_block", F.col("epochs"), F.lit(target.seed)).alias("_turn")
    ranked = global_running_sum(
        filled.select("_source", "_block", "_size", turn, "epochs", (F.col("quota") - F.col("epochs") * F.col("tokens")).alias("_rest")),
        ["_source"], [F.col("_turn"), F.col("_block")], "_size", "_upto",
    )
    whole = F.col("_rest") >= F.col("_upto")
    before = F.col("_upto") - F.col("_size")
    cut = F.when(~whole & (F.col("_rest") > before), F.col("_rest") - before)
    blocks = reliable(ranked.select(
        "_source", "_block", (F.col("epochs") + F.when(whole & (F.col("_rest") > 0), 1).otherwise(0)).alias("_copies"), cut.alias("_cut"), "epochs"
    ))
    return sources, blocks


def _placed(rows: DataFrame, sources: DataFrame, target: Target) -> DataFrame:
    """Rows with the block of their source that they are dealt to."""
    known = bounded(sources.select("_source", "tokens", "quota", "epochs", "blocks"))
    return rows.join(known, "_source").withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(target.seed)), F.col("blocks")))


def _dealt(rows: DataFrame, sources: DataFrame, blocks: DataFrame, target: Target) -> DataFrame:
    """Rows (_source, _key, _tokens, more) with _copies, the number of times that each is given out."""
    more = [c for c in rows.columns if c not in ("_source", "_key", "_tokens")]
    placed = _placed(rows, sources, target).join(bounded(blocks.select("_source", "_block", "_copies", "_cut")), ["_source", "_block"])
    kept = ["_source", "_block", "_key", "_tokens", "_copies", *more]
    plain = placed.where("_cut is null").select(*kept)
    # At most one block of each source, ordered by itself.
    order = Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_key", F.lit(target.seed + 1)), "_key")
    upto = F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = placed.where("_cut is not null").withColumn("_upto", upto)
    last = last.withColumn("_copies", F.col("_copies") + F.when(F.col("_upto") <= F.col("_cut"), 1).otherwise(0)).select(*kept)
    return plain.unionByName(last)


def _working(docs: DataFrame, tokens: Column | None, *more: Column) -> DataFrame:
    tokens = count_words(F.col("text").cast("string")) if tokens is None else tokens
    return with_package(docs).select(_source("source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_key"), tokens.alias("_tokens"), *more)


def schedule(docs: DataFrame, target: Target, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, epoch, at, n_tokens, weight): one row for each time that a document is given out.

    docs: doc_id, source, text; other columns are ignored. tokens: a column that counts a row's tokens; words if None.
    `epoch` numbers the passes through the source from 0, `at` in [0, 1) orders the whole stream: within an epoch the
    blocks of a source are permuted, and the documents within a block; sources go in parallel. A null source is the
    empty one; rows with null ids are dealt alike; repeated rows are given out each for itself; empty texts cost
    nothing. An empty table gives an empty schedule. With a budget below one epoch a source is sampled, by whole
    blocks and a part of one; without a budget nothing is left out.
    """
    narrow = reliable(_working(docs, tokens, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source")))
    sources, blocks = plan(narrow, target)
    dealt = _dealt(narrow, sources, blocks, target).where("_copies > 0")
    each = dealt.select("doc_id", "source", "_source", "_block", "_key", "_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("epoch"))
    each = each.join(bounded(sources.select("_source", "quota", "tokens", "weight")), "_source")
    unit = lambda *c: (F.xxhash64(*c) / F.lit(2.0**64) + 0.5)
    turn = unit("_source", "_block", "epoch", F.lit(target.seed)) + unit("_key", "epoch", F.lit(target.seed + 1)) / 2.0**20
    passes = F.greatest(F.col("quota") / F.greatest(F.col("tokens"), F.lit(1)), F.lit(1.0))
    at = F.least((F.col("epoch") + turn) / F.ceil(passes), F.lit(1.0 - 2.0**-53))
    return each.select("doc_id", "source", "epoch", at.alias("at"), F.col("_tokens").alias("n_tokens"), "weight")


def mixed(docs: DataFrame, target: Target, tokens: Column | None = None) -> DataFrame:
    """The rows of `docs`, all columns, each as often as :func:`schedule` gives it out. Texts are not shuffled,
    except for the one block of each source that may be cut."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    narrow = reliable(_working(docs, tokens))
    sources, blocks = plan(narrow, target)
    dealt = _dealt(_working(docs, tokens, row), sources, blocks, target)
    return dealt.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
