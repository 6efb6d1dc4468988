"""Trust scoring: component factors, composites, decay, signal aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.exprs import age_decay, clamp, log_share, ladder

#: Weights of the composite and limits of its inputs, fixed values.
WEIGHTS = {"verification": 0.35, "age": 0.10, "activity": 0.0, "reputation": 0.0, "community": 0.0, "external": 0.35, "scan": 0.20}
CLAIM_CAPS = {"identity": 0.60, "authority": 0.25, "continuity": 0.15, "transport": 0.0}
ACCOUNT_WEIGHTS = {"verified_oauth": 1.0, "verified_challenge": 0.85, "unverified_claim": 0.25, "pending": 0.0}
CONTEXT_BOOST = 1.5
#: External reputation of an entity without linked accounts whose source is verified: a share of its source's signals, or a constant without any.
SOURCE_SHARE, SOURCE_ONLY = 0.70, 0.60
#: Logarithms and shares of the components.
AGE_DAYS, ACTIVITY_TOP, ENDORSEMENT_TOP, STARS, RATING_SHARE = 365.0, 100.0, 20.0, 5, 0.6
SIGNAL_TOPS = {"stars": 5.0, "downloads": 6.0, "forks": 4.0, "likes": 4.0}
HUMAN_SHIFT, KEPT_SHARE = 0.10, 0.80
FRESHNESS_SECONDS, CONFLICT, RETAIN, FLOOR = 86400, 0.30, 0.5, -0.20

assert abs(sum(WEIGHTS.values()) - 1) < 1e-9 and max(WEIGHTS.values()) <= 0.40


def verification(source: Column, email: Column, bio: Column, operator: Column) -> Column:
    """Evidence of identity, each part with its share, at most 1."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    has_bio = F.coalesce(F.trim(bio) != "", F.lit(False))
    return F.least(part(source, 0.15) + part(email, 0.30) + part(has_bio, 0.20) + part(operator, 0.25), F.lit(1.0))


def age(days: Column) -> Column:
    return F.least(F.greatest(days, F.lit(0)) / AGE_DAYS, F.lit(1.0))


def activity(n: Column) -> Column:
    return F.least(F.log(n + 1.0) / F.log(F.lit(ACTIVITY_TOP)), F.lit(1.0))


def reputation(rating: Column, endorsements: Column) -> Column:
    """Mean rating of 5 and endorsements on a log scale, 60 to 40 where both exist, else the one that does."""
    stars, known = rating / STARS, F.least(F.log(endorsements + 1.0) / F.log(F.lit(ENDORSEMENT_TOP)), F.lit(1.0))
    has = F.coalesce(endorsements, F.lit(0)) > 0
    return F.when(rating.isNotNull() & has, RATING_SHARE * stars + (1 - RATING_SHARE) * known).when(rating.isNotNull(), stars).when(has, known).otherwise(0.0)


def source_reputation(stars: Column, downloads: Column, forks: Column, likes: Column, most: float | None = 1.0) -> Column:
    """The best of four community signals on log scales, each at most ``most``; without bound where that is None."""
    scaled = [F.log10(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1.0) / top for c, top in zip((stars, downloads, forks, likes), SIGNAL_TOPS.values(), strict=True)]
    return F.greatest(*(scaled if most is None else [F.least(x, F.lit(most)) for x in scaled]))


def external(linked: Column, verified: Column, signals: Column) -> Column:
    """External reputation: the linked accounts' mean where there is one, else what a verified source is worth, else 0.

    ``signals`` is the source's reputation, null where nothing is known of it.
    """
    return F.when(linked.isNotNull(), linked).when(verified, F.when(signals.isNotNull(), signals * SOURCE_SHARE).otherwise(SOURCE_ONLY)).otherwise(0.0)


def with_chain(signals: Column, chain: Column) -> Column:
    """Source signals and the score of on-chain attestations do not add up: the greater counts."""
    return F.greatest(signals, F.coalesce(chain, F.lit(0.0)))


def recent_activity(acts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Per entity of ``acts(id, us)`` the activity of the last days: posts and votes alike, each a row."""
    n = acts.where(F.col("us") >= now - days * 86_400_000_000).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("id", activity(F.col("n")).alias("activity"))


def composite(mode: str = "batch", human: Column | None = None, modifier: Column | None = None, previous: Column | None = None) -> Column:
    """The weighted score over columns named as the components.

    ``batch``: the plain sum. ``single``: humans move the scan's weight to verification and external, and a score
    keeps at least 80 % of the previous one. Both apply the framework modifier where it is known.
    """
    part = lambda n, w=None: F.coalesce(F.col(n), F.lit(0.0)) * (WEIGHTS[n] if w is None else w)
    total = sum((part(n) for n in WEIGHTS), F.lit(0.0))
    if mode == "single" and human is not None:
        moved = total + part("verification", HUMAN_SHIFT) + part("external", HUMAN_SHIFT) - part("scan")
        total = F.when(human, moved).otherwise(total)
    if modifier is not None:
        total = total * F.coalesce(modifier, F.lit(1.0))
    if mode == "single" and previous is not None:
        total = F.when(previous > 0, F.greatest(total, previous * KEPT_SHARE)).otherwise(total)
    return total


def community(attestations: DataFrame, now: Column, cap: int = 10, boost: str | None = None) -> DataFrame:
    """Per target: mean decayed weight of the earliest ``cap`` attestations of each attester, at most 1, and the mean per context.

    ``attestations(event_id, attester, target, context, weight, us)``; a null weight counts 0.5. Attestations of the
    context ``boost`` count half as much again in the overall mean, not in that of the context.
    """
    w = W.partitionBy("target", "attester").orderBy("us", "event_id")
    days = F.floor((now - F.col("us")) / 86_400_000_000)
    kept = attestations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    kept = kept.withColumn("w", F.coalesce("weight", F.lit(0.5)) * age_decay(days))
    by_context = kept.groupBy("target", "context").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("context").isNotNull(), F.struct("context", F.least(F.col("total") / F.col("n"), F.lit(1.0)).alias("mean")))
    share = F.when(F.col("context") == boost, CONTEXT_BOOST).otherwise(1.0) if boost else F.lit(1.0)
    overall = F.least(F.sum(F.col("total") * share) / F.sum("n"), F.lit(1.0))
    return by_context.groupBy("target").agg(overall.alias("community"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("contexts"))


def recency(days: Column) -> Column:
    """1 within 30 days of the last activity, 0.5 within 90, else (or never) 0.25."""
    return F.when(days <= 30, 1.0).when(days <= 90, 0.5).otherwise(0.25)


def with_recency(score: Column, days: Column) -> Column:
    r = recency(days)
    return F.when(r < 1, score * (0.5 + 0.5 * r)).otherwise(score)


def blend(base: Column, context: Column) -> Column:
    return F.when(context.isNotNull(), 0.7 * base + 0.3 * context).otherwise(base)


def diversity(providers: Column) -> Column:
    """Discount of attributed signals by the number of distinct providers; none for zero."""
    return F.when(providers >= 4, 1.0).when(providers >= 2, 0.9).when(providers == 1, 0.7).otherwise(1.0)


def aggregate_signals(signals: DataFrame) -> DataFrame:
    """Envelope sums per subject of ``signals(subject, claim, provider, raw, age, ttl, cap)``.

    Expired signals go; the rest are capped with their sign, decay by age, and where they have a provider are
    discounted by the subject's provider diversity. A signal that differs by more than 0.30 from another of its claim
    and provider is contested and keeps at least half its cap. Sums have the floor -0.20 and are clamped to [0, 1].
    """
    live = signals.where("age <= ttl")
    caps = F.create_map(*[F.lit(x) for kv in CLAIM_CAPS.items() for x in kv])
    cap = F.coalesce("cap", F.when(F.col("claim").isNotNull(), F.coalesce(caps[F.col("claim")], F.lit(0.0))), F.lit(1.0))
    group = W.partitionBy("subject", "claim", "provider")
    spread = F.greatest(F.max("raw").over(group) - F.col("raw"), F.col("raw") - F.min("raw").over(group))
    contested = F.col("claim").isNotNull() & F.col("provider").isNotNull() & (spread > CONFLICT)
    live = live.withColumn("cap", cap).withColumn("contested", contested)
    decayed = clamp_by(F.col("raw"), F.col("cap")) * F.when(F.col("age") <= 0, 1.0).otherwise(F.exp(-F.col("age") / FRESHNESS_SECONDS))
    counted = live.groupBy("subject").agg(F.count_distinct("provider").alias("_providers"))
    live = live.join(counted, "subject").withColumn("diversity", diversity(F.col("_providers")))
    weighted = decayed * F.when(F.col("provider").isNotNull(), F.col("diversity")).otherwise(1.0)
    kept = RETAIN * F.col("cap")
    weighted = F.when(F.col("contested"), F.when(weighted >= 0, F.greatest(weighted, kept)).otherwise(F.least(weighted, -kept))).otherwise(weighted)
    total = F.greatest(F.sum(F.round(weighted, 4)), F.lit(FLOOR))
    return live.groupBy("subject").agg(F.count(F.lit(1)).alias("signals"), F.count_if("contested").alias("contested"), F.round(clamp(total, 0.0, 1.0), 4).alias("score"))


def clamp_by(value: Column, cap: Column) -> Column:
    return F.greatest(F.least(value, cap), -cap)


def chain_score(attestations: DataFrame) -> DataFrame:
    """Per subject, the capped strength of admissible claims ``(subject, claim, provider)``: diversity before count."""
    n, p = F.col("n"), F.col("providers")
    strength = F.least(F.least(0.5 + (p - 1) * 0.25, F.lit(1.0)) + F.when(n > 1, F.least(F.log10(n + 1.0) / 10, F.lit(0.1))).otherwise(0.0), F.lit(1.0))
    caps = F.create_map(*[F.lit(x) for kv in CLAIM_CAPS.items() for x in kv])
    by_claim = attestations.groupBy("subject", "claim").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("provider").alias("providers"))
    by_claim = by_claim.withColumn("part", F.coalesce(caps[F.col("claim")], F.lit(0.0)) * strength)
    return by_claim.groupBy("subject").agg(F.round(F.least(F.sum("part"), F.lit(1.0)), 4).alias("score"))


#: The least trust of each gated action, the standings by the ratio to the mean, and the least score and days of grace to publish.
ACTION_GATES = {
    "post_create": 0.0, "post_to_group": 0.05, "create_listing": 0.15, "create_group": 0.25, "send_message": 0.0, "create_webhook": 0.10,
    "api_key_create": 0.10, "endorsement_create": 0.15, "dispute_create": 0.10, "media_upload": 0.10,
}
STANDINGS = (
    (2.0, "Top 5% — well above platform average"), (1.5, "Top 15% — significantly above average"), (1.1, "Top 35% — above average"),
    (0.9, "Around average"), (0.6, "Below average — room for improvement"),
)
LOWEST_STANDING, NO_STANDING = "Bottom 20% — significant improvement possible", "Not enough data to estimate percentile"
PUBLISH_SCORE, PUBLISH_GRACE_DAYS = 0.3, 7


def standing(relative: Column, mean: Column) -> Column:
    """A standing in words from a score's ratio to the mean."""
    return F.when(mean == 0, NO_STANDING).otherwise(ladder(F.when(mean > 0, relative).otherwise(0.0), STANDINGS, LOWEST_STANDING))


def may_publish(score: Column, days: Column) -> Column:
    """No score yet, enough of it, or still in the days of grace."""
    return score.isNull() | (score >= PUBLISH_SCORE) | F.coalesce(days < PUBLISH_GRACE_DAYS, F.lit(False))


def contributions(rows: DataFrame, parts: dict[str, tuple[Column, Column]], modifier: Column) -> DataFrame:
    """A row (source, raw, weighted) for each component (value, weight) of each row whose product with the modifier is not 0."""
    entries = F.array(*[F.struct(F.lit(n).alias("source"), raw.alias("raw"), (weight * raw * modifier).alias("weighted")) for n, (raw, weight) in parts.items()])
    return rows.withColumn("_part", F.explode(entries)).where("_part.weighted <> 0").select(*rows.columns, "_part.*")


#: Labels by score, and suggestions: component, from, below, only for agents, gain, text.
LABELS = ((0.8, "Exceptional"), (0.6, "High"), (0.3, "Moderate"))
SUGGESTIONS = (
    ("verification", None, 0.3, False, 0.3 * 0.35, "Verify your email address to jump from 0.0 to 0.3."),
    ("verification", 0.3, 0.5, False, 0.2 * 0.35, "Complete your profile bio to reach 0.5 verification."),
    ("verification", 0.5, 0.7, True, 0.2 * 0.35, "Link to an operator account for the highest verification tier."),
    ("activity", None, 0.3, False, 0.3 * 0.20, "Increase your engagement — post, reply, and vote regularly in the next 30 days."),
    ("community", None, 0.3, False, 0.3 * 0.20, "Earn trust attestations from other community members. Focus on building genuine relationships."),
    ("reputation", None, 0.3, False, 0.3 * 0.15, "Seek peer reviews and capability endorsements to improve your trust score."),
)


def score_label(score: Column) -> Column:
    return ladder(score, LABELS, "Low")


def suggestions(rows: DataFrame, agent: Column) -> DataFrame:
    """A row (component, suggestion, potential_gain) for each suggestion that fits an entity's components; missing ones count 0."""
    fits = []
    for component, low, high, agents, gain, text in SUGGESTIONS:
        value = F.coalesce(F.col(component), F.lit(0.0))
        hit = (value < high) & (F.lit(True) if low is None else value >= low) & (agent if agents else F.lit(True))
        fits.append(F.when(hit, F.struct(F.lit(component).alias("component"), F.lit(text).alias("suggestion"), F.lit(round(gain, 4)).alias("potential_gain"))))
    return rows.withColumn("_s", F.explode(F.array_compact(F.array(*fits)))).select(*rows.columns, "_s.*")


def npm_reputation(downloads: Column, versions: Column, maintainers: Column) -> Column:
    return 0.50 * log_share(downloads, 100_001) + 0.30 * log_share(versions, 51) + 0.20 * F.least(maintainers / 5.0, F.lit(1.0))


def pypi_reputation(downloads: Column, releases: Column, classifiers: Column) -> Column:
    return 0.40 * log_share(downloads, 100_001) + 0.35 * log_share(releases, 51) + 0.25 * F.least(classifiers / 10.0, F.lit(1.0))


def model_reputation(downloads: Column, likes: Column, has_card: Column) -> Column:
    return 0.45 * log_share(downloads, 50_001) + 0.35 * log_share(likes, 201) + 0.20 * has_card.cast("int")


def image_reputation(pulls: Column, stars: Column, official: Column) -> Column:
    return 0.60 * log_share(pulls, 1_000_001) + 0.25 * log_share(stars, 501) + 0.15 * official.cast("int")


def repository_reputation(stars: Column, forks: Column, followers: Column, recent_share: Column, age_days: Column, repos: Column) -> Column:
    """A code-hosting account's reputation from log-normalised counts, recency and age."""
    return 0.20 * log_share(stars, 501) + 0.25 * log_share(followers + forks, 201) + 0.20 * F.least(recent_share * 1.5, F.lit(1.0)) + 0.15 * F.least(age_days / 1095.0, F.lit(1.0)) + 0.20 * log_share(repos, 101)


def endpoint_reputation(uptime: Column, response_ms: Column, checks: Column) -> Column:
    """Uptime in steps with a bonus for quick answers; 0 below three checks."""
    base = F.when(uptime >= 99, 0.8).when(uptime >= 95, 0.6).when(uptime >= 90, 0.4).when(uptime >= 80, 0.2).otherwise(0.0)
    bonus = F.when(response_ms < 200, 0.2).when(response_ms < 500, 0.1).otherwise(0.0)
    return F.when(checks < 3, 0.0).otherwise(F.least(base + bonus, F.lit(1.0)))
