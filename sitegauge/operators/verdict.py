"""Combined owner score and the verdict cascade that assigns every place to a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge import texts
from sitegauge.functions.evidence import empty, or_empty, strongest, strongest_counts, total
from sitegauge.functions.text import clamp, phrase
from sitegauge.operators.filters import all_types, excluded_type
from sitegauge.operators.merge import by_prefix
from sitegauge.params import DEFAULT, MAX_REVIEW_BOOST, Preset

# --- fixed values -----------------------------------------------------------
NAME_AND_TYPE_CAP = 40
NO_SITE_LEAD_SCORE = 26
# --- end of fixed values ----------------------------------------------------

def combine_name_and_type(df: DataFrame, name: str, kind: str, out: str) -> DataFrame:
    """Add the sum of the two signals, capped; an excluded name stays as it is."""
    n, k = F.col(name), F.col(kind)
    excluded = n["exclusion"].isNotNull()
    return df.withColumn(
        out,
        F.struct(
            F.when(excluded, n["score"]).otherwise(F.least(F.lit(NAME_AND_TYPE_CAP), n["score"] + k["score"])).cast("int").alias("score"),
            n["exclusion"].alias("exclusion"),
            F.when(excluded, n["evidence"]).otherwise(F.concat(n["evidence"], k["evidence"])).alias("evidence"),
        ),
    )


def owner_score(df: DataFrame, site: str | None, reviews: str | None, name: str, versions: str | None,
                preset: Preset = DEFAULT, out: str = "owner") -> DataFrame:
    """Add ``struct(score, lang, evidence, exclusion, bucket)`` from four named columns.

    Version evidence is one fact found several ways, so only the strongest counts;
    site, review and name evidence are added without their own caps.
    ``site`` has ``lang``, ``hard_exclusion``, ``evidence``; ``reviews`` has
    ``preferred_lang`` and ``evidence``; ``name`` has ``exclusion`` and ``evidence``.
    The list is built in one projection and summed in the next.
    """
    null = F.lit(None).cast("string")

    def part(column: str | None, field: str) -> Column:
        return null if column is None else F.col(column)[field]

    lists = [or_empty(F.col(c)["evidence"]) for c in (site, reviews, name) if c]
    found = or_empty(F.col(versions)) if versions else empty()
    staged = (
        df.withColumn("_parts", F.concat(strongest_counts(found), *lists))
        .withColumn("_excluded", F.coalesce(part(site, "hard_exclusion"), part(name, "exclusion")))
        .withColumn("_score", F.when(F.col("_excluded").isNotNull(), 0).otherwise(clamp(total(F.col("_parts")), 0, 100)))
        .withColumn("_named", strongest(found)["detail"])
    )
    known = None
    for code in preset.language.codes:
        named = F.col("_named").rlike(rf"(?i)\b{code}\b")
        known = F.when(named, code) if known is None else known.when(named, code)
    lang = F.coalesce(part(site, "lang"), part(reviews, "preferred_lang"), known)
    proof = or_empty(F.col(name)["evidence"])
    if site:
        proof = F.when(F.col(site)["hard_exclusion"].isNotNull(), or_empty(F.col(site)["evidence"])).otherwise(proof)
    excluded, score, t = F.col("_excluded"), F.col("_score"), preset.thresholds
    return staged.withColumn(
        out,
        F.struct(
            score.cast("int").alias("score"),
            F.when(excluded.isNull(), lang).alias("lang"),
            F.when(excluded.isNotNull(), proof).otherwise(F.col("_parts")).alias("evidence"),
            excluded.alias("exclusion"),
            F.when(score >= t.lead, "leads").when(score >= t.manual, "manual").otherwise("rejected").alias("bucket"),
        ),
    ).drop("_parts", "_excluded", "_score", "_named")


def _out(bucket: str | Column, reason: Column | None, rule: int) -> Column:
    bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
    reason = F.lit(None).cast("string") if reason is None else reason
    return F.struct(bucket.alias("bucket"), reason.alias("reason"), F.lit(rule).alias("rule_no"))


def decide(preset: Preset = DEFAULT) -> Column:
    """``struct(bucket, reason, rule_no)`` of the twelve ordered outcomes.

    Reads the columns ``pin_verdict``, ``pin_reason``, ``primary_type``, ``types``,
    ``user_rating_count``, ``owner`` (struct), ``has_audit``, ``fetch_error``,
    ``modern_framework``, ``site_status``, ``site_score``, ``dated_markers``,
    ``psi_done`` and ``has_reviews``.
    """
    f, t = preset.filters, preset.thresholds
    kind = excluded_type(all_types(F.col("primary_type"), F.col("types"), f.primary_type_counts), f.excluded_types)
    owner = F.col("owner")
    score, exclusion = owner["score"], owner["exclusion"]
    reviews = F.col("user_rating_count")
    blocked = F.col("site_status") == "blocked"
    unread = ~F.col("has_audit") | F.col("fetch_error").isNotNull() | blocked
    modern = F.coalesce(F.col("modern_framework"), F.lit("")) != ""
    undated = F.size(F.col("dated_markers")) <= 0
    good = F.col("psi_done") & (F.col("site_score") > t.site_score_max_for_lead) & (score >= t.lead)
    out = (
        F.when(F.col("pin_verdict").isNotNull(), _out(F.col("pin_verdict"), F.col("pin_reason"), 1))
        .when(kind.isNotNull(), _out("rejected", phrase(texts.EXCLUDED_TYPE, kind), 2))
        .when(
            reviews.isNotNull() & (reviews < f.min_review_count),
            _out("rejected", phrase(texts.TOO_FEW_REVIEWS, reviews, F.lit(f.min_review_count)), 3),
        )
        .when(exclusion.isNotNull(), _out("rejected", phrase(texts.EXCLUSION, exclusion), 4))
        .when(blocked & (score >= t.manual), _out("manual", F.lit(texts.BLOCKED_TO_MANUAL), 5))
    )
    if f.modern_stack_is_rejection:
        out = out.when(~unread & modern, _out("rejected", phrase(texts.MODERN_STACK, F.col("modern_framework")), 6))
    return (
        out.when(~unread & undated & good, _out("upsell", phrase(texts.UPSELL, score, F.col("site_score")), 7))
        .when(score >= t.lead, _out("leads", None, 8))
        .when(~F.col("has_reviews") & (unread | (score + MAX_REVIEW_BOOST >= t.manual)), _out("pending", None, 9))
        .when(score >= t.manual, _out("manual", None, 10))
        .when(unread, _out("manual", phrase(texts.UNREAD, F.coalesce(F.col("fetch_error"), F.lit("no response"))), 11))
        .otherwise(_out("rejected", phrase(texts.WEAK_SIGNAL, score), 12))
    )


def apply_verdict(inputs: DataFrame, preset: Preset = DEFAULT) -> DataFrame:
    """Set ``bucket``, ``reject_reason`` and ``rule_no``; the old bucket is kept beside it.

    Outcomes 1-3 are taken before a score is looked at, so they publish none.
    """
    v = F.col("_verdict")
    return (
        inputs.withColumn("_verdict", decide(preset))
        .withColumn("old_bucket", F.col("bucket"))
        .withColumn("bucket", v["bucket"])
        .withColumn("reject_reason", v["reason"])
        .withColumn("rule_no", v["rule_no"])
        .withColumn("owner_score", F.when(v["rule_no"] > 3, F.col("owner")["score"]))
        .drop("_verdict")
    )


def with_pins(state: DataFrame, pins: DataFrame) -> DataFrame:
    """Join the human verdicts; no scoring job ever writes this table."""
    chosen = pins.groupBy("place_id").agg(
        F.max_by(F.struct("verdict", "reason"), F.col("at")).alias("_pin")
    )
    return (
        state.join(chosen, "place_id", "left")
        .withColumn("pin_verdict", F.col("_pin")["verdict"])
        .withColumn("pin_reason", F.col("_pin")["reason"])
        .drop("_pin")
    )


def score_without_site(state: DataFrame, name_signal: str, preset: Preset = DEFAULT) -> DataFrame:
    """Places without a site: excluded types are rejected, the others get a name-only score."""
    rows = state.where(F.col("bucket") == "no_site").withColumn(
        "excluded_type", excluded_type(F.col("types"), preset.filters.excluded_types)
    )
    scored = owner_score(rows, None, None, name_signal, None, preset, "_owner")
    s = F.col("owner")["score"]
    return (
        scored.withColumn("owner", F.when(F.col("excluded_type").isNull(), F.col("_owner")))
        .drop("_owner")
        .withColumn(
            "band",
            F.when(F.col("excluded_type").isNotNull(), "excluded").when(s >= 30, "30+").when(s >= 20, "20-29")
            .when(s >= 10, "10-19").when(s > 0, "1-9").otherwise("0"),
        )
    )


def promote_without_site(state: DataFrame, not_business: tuple[str, ...] = (),
                         cut: int = NO_SITE_LEAD_SCORE) -> DataFrame:
    """New pins for places without a site whose score is high enough."""
    named = F.lit(False)
    for prefix in not_business:
        named = named | F.lower(F.trim(F.col("name"))).startswith(prefix.lower())
    return state.where((F.col("bucket") == "no_site") & (F.col("owner_score") >= cut)).select(
        "place_id",
        F.when(named, "rejected").otherwise("no_site_lead").alias("verdict"),
        F.when(named, texts.NOT_A_BUSINESS)
        .otherwise(phrase(texts.NO_SITE_LEAD, F.col("owner_score"))).alias("reason"),
    )


def pick_by_prefix(state: DataFrame, picks: list[tuple[str, str]]) -> DataFrame:
    """Hand-picked names to pins, guarded: only unread sites or scores up to 6 pass.

    ``picks`` is a list of (name prefix, why), of any length; the first that fits counts.
    """
    listed = state.sparkSession.createDataFrame([(i, p, w) for i, (p, w) in enumerate(picks)], "_i int, _prefix string, _why string")
    unread = ~F.col("has_audit") | F.col("fetch_error").isNotNull()
    score = F.coalesce(F.col("site_score"), F.lit(10))
    open_ = state.where(F.col("bucket").isin("manual", "pending"))
    first = by_prefix(open_.select("place_id", "name"), "name", listed, "_prefix").groupBy("place_id").agg(F.min_by("_why", "_i").alias("why"))
    return (
        open_.join(first, "place_id")
        .withColumn("passes", unread | (score <= 6))
        .withColumn(
            "state",
            F.when(unread, "сайт не прочитано").otherwise(phrase("сайт %s/10", score)),
        )
    )
