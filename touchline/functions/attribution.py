"""Per-row attribution rules (source classifier, match label, lookback)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def classify_source(utm_source, referrer) -> Column:
    """COALESCE(utmSource, CASE on the page referrer ...).

    Order of tests: missing or empty referrer -> direct, then google,
    facebook, instagram (case-sensitive substring), else referral.  An
    empty utmSource is a value and wins over the referrer rule.
    """
    ref = _c(referrer)
    # The referrer classes and their match words.
    by_referrer = (F.when(ref.isNull() | (ref == F.lit("")), F.lit("direct"))
                   .when(ref.contains("google"), F.lit("google"))
                   .when(ref.contains("facebook"), F.lit("facebook"))
                   .when(ref.contains("instagram"), F.lit("instagram"))
                   .otherwise(F.lit("referral")))
    return F.coalesce(_c(utm_source), by_referrer)


def match_type(o_user, t_user, o_ip, t_ip, o_ts, t_ts) -> Column:
    """userId_match / ip_match / no_match.  A NULL userId never matches on
    user and falls through to the ip test."""
    return (F.when(_c(o_user) == _c(t_user), F.lit("userId_match"))
            .when((_c(o_ip) == _c(t_ip)) & (_c(o_ts) == _c(t_ts)), F.lit("ip_match"))
            .otherwise(F.lit("no_match")))


UNITS_PER_SECOND = {"s": 1, "ms": 1000}


def within_lookback(t_ts, o_ts, days: int, epoch_unit: str = "s") -> Column:
    """1 when the touch lies in [order - days, order], else 0.  Timestamps
    are epoch numbers in ``epoch_unit`` ('s' or 'ms')."""
    span = F.lit(int(days) * 24 * 60 * 60 * UNITS_PER_SECOND[epoch_unit])
    t, o = _c(t_ts), _c(o_ts)
    return F.when((t <= o) & (t >= o - span), F.lit(1)).otherwise(F.lit(0))
