"""Evidence scores and baselines (F1-F8, F23-F26 parts in conditions)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Prior probability and horizon in months of each target.
TARGETS = {
    "material_capacity_expansion": (0.15, 18),
    "restructuring_announced": (0.12, 12),
    "profit_trading_warning": (0.08, 6),
    "operating_margin_deterioration": (0.20, 12),
    "senior_operational_leadership_change": (0.15, 12),
}
# Weights of the rule score's inputs.
RULE_WEIGHTS = {"pressure_language": 1.4, "margin_pressure": 0.9, "cash_pressure": 0.7, "contrary_strength": -0.8}
# Weight of each evidence family in two models.
FAMILY_WEIGHTS = {
    "operational_pressure": {"workforce_demand_skills": 0.15, "operational_disclosure": 0.16, "leadership_organisation": 0.12, "capacity_footprint": 0.10, "procurement_contracts": 0.09, "product_quality_customer": 0.12, "corporate_actions": 0.07, "web_narrative": 0.07, "sector_macro": 0.07, "financial_state": 0.05},
    "expansion_transformation": {"workforce_demand_skills": 0.22, "operational_disclosure": 0.10, "leadership_organisation": 0.12, "capacity_footprint": 0.16, "procurement_contracts": 0.12, "product_quality_customer": 0.08, "corporate_actions": 0.06, "web_narrative": 0.06, "sector_macro": 0.04, "financial_state": 0.04},
}
# Half-life in days of features that a catalogue does not give; others have 365.
HALF_LIVES = {"vacancy_spike": 90, "persistent_skill_shift": 270, "executive_departure": 365, "delivery_quality_event": 180, "repeated_operational_language": 270, "contract_order_event": 365, "capacity_site_change": 730, "acquisition_integration": 730, "financial_structural": 540, "recall_enforcement": 540}
CLUSTER_CAP, ONE_CLUSTER_CAP, OWN_SOURCES_CAP = 0.20, 0.55, 0.70


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def target_probability(contributions: DataFrame, by: Sequence[str], priors: dict[str, float] | None = None, scale: float = 4.0) -> DataFrame:
    """sigmoid(logit(prior) + 4 * sum): supporting values count as they are, others as minus their size (F1)."""
    priors = priors or {k: p for k, (p, _) in TARGETS.items()}
    signed = F.when(F.col("relationship") == "supports", F.col("value")).otherwise(-F.abs("value"))
    prior = F.create_map(*(x for k, p in priors.items() for x in (F.lit(k), F.lit(logit(p)))))
    sums = contributions.groupBy(*by, "target").agg(F.sum(signed).alias("signed"))
    return sums.withColumn("probability", F.bround(sigmoid(F.try_element_at(prior, F.col("target")) + scale * F.col("signed")), 6))


def rules_score(df: DataFrame, prior: float = 0.12, weights: dict[str, float] | None = None) -> DataFrame:
    """`df` with probability, contributions and error: inputs outside 0 to 1 or missing are errors without a score (F2)."""
    weights = weights or RULE_WEIGHTS
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(c)) for c in weights)))
    parts = F.create_map(*(x for c, w in weights.items() for x in (F.lit(c), F.col(c) * w)))
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(logit(prior)))
    ok = F.size(bad) == 0
    return df.withColumn("error", bad).withColumn("contributions", F.when(ok, parts)).withColumn("probability", F.when(ok, F.bround(sigmoid(total), 6)))


def recency(age_days: Column, half_life: Column) -> Column:
    """Half the weight for each half-life; a future event has age 0."""
    return F.exp(-math.log(2) * F.greatest(F.lit(0), age_days) / half_life)


def half_life(catalogue: Column | None = None) -> Column:
    known = F.try_element_at(F.create_map(*(x for k, v in HALF_LIVES.items() for x in (F.lit(k), F.lit(v)))), F.col("feature"))
    return F.coalesce(*([catalogue] if catalogue is not None else []), known, F.lit(365))


def evidence_contributions(df: DataFrame, as_of: str, weights: dict[str, float], by: Sequence[str] = ("company_id",), cap: float = CLUSTER_CAP) -> DataFrame:
    """Eligible observations with their contribution, scaled so that a cluster's sum has at most `cap`.

    Families without a weight have no contribution (null) but stay: they count for clusters and quality.
    The sum of a cluster is aggregated before it is joined back, so a large cluster is no large window.
    """
    day = F.lit(as_of).cast("date")
    weight = F.try_element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))), F.col("family"))
    raw = weight * F.col("strength") * F.col("reliability") * F.col("quality") * F.col("materiality") * recency(F.datediff(day, F.to_date("event_date")), half_life()) * F.col("independence") * F.col("relevance") * F.col("direction")
    rows = df.where(F.to_date("available_at") <= day).withColumn("raw", raw)
    sums = rows.where("raw is not null").groupBy(*by, "cluster").agg(F.sum("raw").alias("cluster_sum"))
    scale = F.when(F.col("cluster_sum") != 0, F.least(F.lit(1.0), cap / F.abs("cluster_sum"))).otherwise(1.0)
    return rows.join(sums, [*by, "cluster"], "left").withColumn("contribution", F.col("raw") * scale).drop("cluster_sum")


def evidence_model(df: DataFrame, as_of: str, weights: dict[str, float], coverage: DataFrame | None = None, by: Sequence[str] = ("company_id",), prior: float = 0.20, scale: float = 5.0) -> DataFrame:
    """evidence_sum, probability, coverage, clusters, confidence of each company.

    coverage (by, family, as_of_date, coverage): the latest row of each family by the date counts; families
    without one count 0. confidence = coverage * mean quality * (1 - exp(-clusters / 3)), capped for a
    single cluster and for sources of the company alone.
    """
    rows = evidence_contributions(df, as_of, weights, by)
    sums = rows.groupBy(*by).agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("evidence_sum"), F.countDistinct("cluster").alias("clusters"), F.avg(F.col("quality") * F.col("reliability")).alias("mean_quality"), F.bool_and("own_source").alias("own"))
    if coverage is None:
        sums = sums.withColumn("coverage", F.lit(1.0))
    else:
        w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
        last = coverage.where(F.col("as_of_date") <= F.lit(as_of).cast("date")).groupBy(*by, "family").agg(F.max_by("coverage", "as_of_date").alias("c"))
        sums = sums.join(last.groupBy(*by).agg(F.sum(F.try_element_at(w, F.col("family")) * F.col("c")).alias("coverage")), list(by), "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    raw = F.col("coverage") * F.col("mean_quality") * (1 - F.exp(-F.col("clusters") / 3))
    capped = F.least(raw, F.when(F.col("clusters") < 2, ONE_CLUSTER_CAP).otherwise(1.0), F.when(F.col("own"), OWN_SOURCES_CAP).otherwise(1.0))
    return sums.select(*by, "evidence_sum", sigmoid(logit(prior) + scale * F.col("evidence_sum")).alias("probability"), "coverage", "clusters", capped.alias("confidence"))


def weighted_score(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score 0 to 100 and confidence from products of factors; both rounded half to even."""
    product = F.col("strength") * F.col("reliability") * F.col("materiality") * F.col("recency") * F.col("independence") * F.col("direction")
    sums = df.groupBy(*by).agg(F.sum(product).alias("signed"), F.avg("reliability").alias("reliability"), F.sum(F.col("strength") * F.col("independence")).alias("mass"))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 50 * F.col("signed"))), 0).cast("int")
    sure = F.bround(F.least(F.lit(100.0), 100 * F.col("reliability") * (1 - 1 / (1 + F.col("mass")))), 0).cast("int")
    return sums.select(*by, score.alias("score"), sure.alias("confidence"))


def pilot_score(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pilot's score: sum of products scaled by 1.35, confidence min(0.85, 0.20 + 0.055 * independence)."""
    product = F.col("strength") * F.col("reliability") * F.col("materiality") * F.col("recency") * F.col("independence") * F.col("relevance") * F.col("direction")
    return df.groupBy(*by).agg((F.sum(product) * 1.35).alias("score"), F.least(F.lit(0.85), 0.20 + 0.055 * F.sum("independence")).alias("confidence"))


def leave_company_out_rate(df: DataFrame, company: str, label: str) -> DataFrame:
    """company, rate of all other companies' labels (F7); null without any other."""
    per = df.groupBy(company).agg(F.sum(label).alias("s"), F.count(label).alias("c"))
    total = per.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    return per.crossJoin(F.broadcast(total)).select(company, F.try_divide(F.col("ts") - F.col("s"), F.col("tc") - F.col("c")).alias("rate"))


def financial_stress(margin: Column, cash: Column) -> Column:
    """(margin flag + cash flag + 1) / 5, flags from 0.60 on."""
    return ((margin >= 0.6).cast("int") + (cash >= 0.6).cast("int") + 1) / 5


def standard_logistic(intercept: float, inputs: dict[str, tuple[float, float, float]]) -> Column:
    """sigmoid(intercept + sum of coefficient * (x - mean) / deviation)."""
    return sigmoid(sum(((F.col(c) - mean) / sd * k for c, (k, mean, sd) in inputs.items()), F.lit(intercept)))


def disclosure_rule(terms: Sequence[str], excluded: Sequence[str], near: int = 120):
    """A column function: whether a term occurs with no excluded phrase that begins or ends within `near` characters (F8)."""

    @pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        def one(s: str | None) -> bool:
            s = " ".join(unicodedata.normalize("NFKC", s or "").lower().split())
            spans = [m.span() for p in excluded for m in re.finditer(re.escape(p), s)]
            return any(all(abs(m.start() - a) > near and abs(m.start() - b) > near for a, b in spans) for t in terms for m in re.finditer(re.escape(t), s))

        return text.map(one).astype(bool)

    return found


def top_contributions(df: DataFrame, by: Sequence[str], value: str, most: int, ties: Sequence[str] = ()) -> DataFrame:
    """The `most` rows of each group that are largest in size, ties in order of the columns `ties` (I8)."""
    w = Window.partitionBy(*by).orderBy(F.abs(value).desc(), *ties)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
