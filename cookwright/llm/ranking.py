"""One ranking from several scores on unlike scales.

Each score is standardised within its request by median and median absolute deviation, squashed by a logistic curve
so that no extreme value decides, and the bounded values are joined by a weighted geometric mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deviations beyond this many robust standard deviations count alike.
BOUND = 4.0
#: Entries of the quantile summaries: groups of up to so many values have exact medians, larger ones a rank error of 1/ACCURACY.
ACCURACY = 10_000
#: A normal distribution's standard deviation over its median absolute deviation, and over its mean absolute deviation.
MAD_SCALE, MEAN_SCALE = 1.4826, 1.2533


def computed(score: Column, missing: float | None = None) -> Column:
    """The score, or null where it was not computed: null, NaN, infinite or the value ``missing`` that stands for it."""
    given = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(given if missing is None else given & (score != missing), score)


def fused_scores(rows: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, missing: float | None = -1.0) -> DataFrame:
    """``group, item, fused, used``: each candidate with its joint score in (0, 1) and the number of scores it rests on.

    A score that was not computed for a candidate (null, NaN, infinite, or ``missing`` where a number stands for that)
    says nothing: the mean is over those it has. Scores may be negative. A group whose values
    of a score are all equal gives 0.5 for it; where more than half are equal, the mean absolute deviation stands in
    for the median one. Candidates without any score are left out, so are rows with a null group or item; repeated
    rows count once, and of unlike rows of one candidate the largest value of each score counts. Medians come from
    mergeable summaries of bounded size, so a group that holds a third of all rows is never gathered in one task;
    two joins on the group follow, which adaptive execution splits where a group is hot.
    """
    weights = weights or [1.0] * len(scores)
    base = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*(F.max(computed(F.col(s).cast("double"), missing)).alias(s) for s in scores))
    mid = base.groupBy(group).agg(*(F.percentile_approx(s, F.lit(0.5), F.lit(ACCURACY)).alias(f"m_{s}") for s in scores))
    off = base.join(mid, group).select(group, item, *(((F.col(s) - F.col(f"m_{s}"))).alias(s) for s in scores))
    spread = off.groupBy(group).agg(
        *(F.percentile_approx(F.abs(s), F.lit(0.5), F.lit(ACCURACY)).alias(f"d_{s}") for s in scores),
        *(F.avg(F.abs(s)).alias(f"a_{s}") for s in scores),
    )
    joined = off.join(spread, group)
    total, used, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for s, w in zip(scores, weights):
        scale = F.when(F.col(f"d_{s}") > 0, F.col(f"d_{s}") * MAD_SCALE).otherwise(F.col(f"a_{s}") * MEAN_SCALE)
        z = F.when(scale > 0, F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col(s) / scale))).otherwise(0.0)
        value = 1 / (1 + F.exp(-z))
        has = F.col(s).isNotNull()
        total = total + F.when(has, w * F.log(value)).otherwise(0.0)
        used = used + F.when(has, w).otherwise(0.0)
        n = n + has.cast("int")
    return joined.select(group, item, F.when(used > 0, F.exp(total / used)).alias("fused"), n.alias("used")).where("fused is not null")


def best_of_each(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The candidate that belongs first in each group; of equal scores (to 12 places) the smaller item."""
    top = F.max_by(F.col(item), F.struct(F.round("fused", 12), -F.col(item)))
    return fused.groupBy(group).agg(top.alias(item))
