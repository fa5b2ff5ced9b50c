"""Order attribution over the web event log.

Input everywhere is the typed event table (``sources.events.event_table``):
one row per event with the fields of ``EVENT_FIELDS``.  ``event_id`` is the
deterministic tie-breaker the source lacks: whenever several touches share a
timestamp, the lower touch event id wins, then the lower order event id.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.attribution import (
    UNITS_PER_SECOND, classify_source, match_type, within_lookback,
)
from touchline.functions.text import month_start_date, month_start_text
from touchline.operators.joins import merge_join
from touchline.operators.sequence import (
    dealt_once, inside, row_number_within, running_by_pieces, unpacked,
)

# Join keys of the two attribution statements.
KEYS_WITH_SHOP = ("ip", "timestamp", "shop")
KEYS_NO_SHOP = ("ip", "timestamp")
KEYS_IDENTITY = ("user",)

_ORDER_SIDE = {
    "event_id": "o_event_id", "timestamp": "o_ts", "userId": "o_user",
    "sessionId": "o_session", "shopifyShopURL": "o_shop", "ip": "o_ip",
    "shopifyOrderId": "order_id", "shopifyOrderProcessedAt": "o_processed_at",
    "shopifyOrderTotalPrice": "o_price",
}
_ORDER_KEY_ALIASES = {"shop": "o_shop", "shopifyShopURL": "o_shop",
                      "shopifyOrderId": "order_id", "order_id": "order_id"}
_KEY_COLS = {"ip": ("o_ip", "t_ip"), "timestamp": ("o_ts", "t_ts"),
             "shop": ("o_shop", "t_shop"), "user": ("o_user", "t_user")}


def thank_you_events(events: DataFrame) -> DataFrame:
    """Events on the order confirmation page."""
    return events.filter(F.col("shopifyPageType") == F.lit("thank_you"))


def has_order(df: DataFrame, col: str = "shopifyOrderId") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def order_events(events: DataFrame) -> DataFrame:
    """Events that carry an order id (any page), renamed to the order side."""
    return has_order(events).select(*[F.col(k).alias(v) for k, v in _ORDER_SIDE.items()])


def _touch_values() -> list[Column]:
    """What a touch shows besides its time, in the order in which touches of
    one time are ranked (the columns of ``_TOUCH_RANK``)."""
    return [F.col("event_id").alias("t_event_id"),
            classify_source(F.col("utmSource"), F.col("pageReferrer")).alias("attribution_source"),
            F.col("pageReferrer").alias("t_referrer"), F.col("utmMedium").alias("t_medium"),
            F.col("utmCampaign").alias("t_campaign"), F.col("userId").alias("t_user"),
            F.col("sessionId").alias("t_session"), F.col("ip").alias("t_ip"),
            F.col("shopifyShopURL").alias("t_shop")]


def touchpoints(events: DataFrame) -> DataFrame:
    """Every event as a touch (order events included) with its source class."""
    return events.select(F.col("timestamp").alias("t_ts"), *_touch_values())


def orders_per_month_store(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct orders per (store, month) over thank-you page events.

    Spark plans the distinct count as an aggregate on (store, month, order)
    followed by a partial count, so no group is gathered whole.
    """
    out = (thank_you_events(events)
           .groupBy(F.col("shopifyShopURL").alias("STORE"),
                    month_start_text(F.col("shopifyOrderProcessedAt")).alias("MONTH"))
           .agg(F.count_distinct("shopifyOrderId").alias("ORDER_COUNT")))
    return out.orderBy("STORE", "MONTH") if ordered else out


def _key_condition(o: DataFrame, t: DataFrame, keys: Sequence[str]):
    return [o[_KEY_COLS[k][0]] == t[_KEY_COLS[k][1]] for k in keys]


def journey(events: DataFrame, keys: Sequence[str] = KEYS_WITH_SHOP,
            days: int = 90, epoch_unit: str = "s") -> DataFrame:
    """Every (order event, touch) pair matching on ``keys`` with the touch
    not after the order, plus ``match_type`` and ``is_within_lookback``.

    This is the full pair relation; AQE splits a skewed key partition of the
    sort-merge join into several tasks.  Operators that only need one touch
    per order (``last_touch``) avoid building it.
    """
    o = order_events(events)
    t = touchpoints(events)
    pairs = merge_join(o, t, _key_condition(o, t, keys)).filter(F.col("t_ts") <= F.col("o_ts"))
    return pairs.select(
        "*",
        match_type("o_user", "t_user", "o_ip", "t_ip", "o_ts", "t_ts").alias("match_type"),
        within_lookback("t_ts", "o_ts", days, epoch_unit).alias("is_within_lookback"))


# Order of touches when several qualify: the latest, then the smallest id,
# then the smallest values of whatever the output shows.
_TOUCH_RANK = ("t_event_id", "attribution_source", "t_referrer", "t_medium", "t_campaign",
               "t_user", "t_session", "t_ip", "t_shop")
_ORDER_RANK = ("o_event_id", "o_processed_at", "o_price", "o_shop", "o_user", "o_ip")
PIECE_SECONDS = 3600


def _touch_rank(*more: str):
    return F.struct((-F.col("t_ts")).alias("_late"), *_TOUCH_RANK, *more)


_EVENT_KEY = {"ip": "ip", "shop": "shopifyShopURL", "user": "userId"}


def as_of_touches(events: DataFrame, keys: Sequence[str], epoch_unit: str = "s",
                  strict: bool = False, touches: Column | None = None) -> DataFrame:
    """Each order event with the last touch of its key up to it, found by one
    scan of one stream instead of a join of orders and touches.

    Every event is a row of the stream: a touch (if ``touches`` holds), an
    order event, or both.  A key's stream is cut into pieces of an hour; within
    a piece a running minimum over the touches' rank gives the last touch so
    far, and a small table with each piece's last touch is carried over to the
    key's later pieces.  The log is read once (both parts share one exchange),
    no order meets a second touch, and a heavy key is cut by time.  ``strict``
    takes touches before the order only.
    """
    width = PIECE_SECONDS * UNITS_PER_SECOND[epoch_unit]
    ekeys = [_EVENT_KEY[k] for k in keys]
    present = F.col("timestamp").isNotNull()
    for c in ekeys:
        present = present & F.col(c).isNotNull()
    touch = F.struct((-F.col("timestamp")).alias("_late"), *_touch_values())
    order = F.struct(*[F.col(k).alias(v) for k, v in _ORDER_SIDE.items()])
    stream = events.filter(present).select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(ekeys)],
        F.floor(F.col("timestamp") / F.lit(width)).alias("piece"), F.col("timestamp").alias("ts"),
        (F.when(touches, touch) if touches is not None else touch).alias("touch"),
        F.when(F.col("shopifyOrderId").isNotNull(), order).alias("order"))
    stream = stream.filter(F.col("touch").isNotNull() | F.col("order").isNotNull())
    names = [f"k{i}" for i in range(len(ekeys))]
    dealt = dealt_once(stream, [*names, "piece"])
    dkeys = [f"_k_{n}" for n in names]

    last = dealt.groupBy(*dkeys, "_k_piece").agg(F.min(inside(lambda r: r["touch"])).alias("m"))
    before = Window.partitionBy(*dkeys).orderBy("_k_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*[F.col(k).alias(f"_c{k}") for k in dkeys], F.col("_k_piece").alias("_c_piece"),
                        F.min("m").over(before).alias("_carried"))
    so_far = (Window.partitionBy(*dkeys, "_k_piece").orderBy("ts")
              .rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow))
    scan = unpacked(dealt).withColumn("_seen", F.min("touch").over(so_far)).filter(F.col("order").isNotNull())
    cond = [scan[k] == carry[f"_c{k}"] for k in dkeys] + [scan["_k_piece"] == carry["_c_piece"]]
    # A touch of the order's own piece is later than any carried into it.
    found = merge_join(scan, carry, cond).select("order.*", F.coalesce("_seen", "_carried").alias("_t"))
    return (found.filter(F.col("_t").isNotNull())
            .select("*", (-F.col("_t._late")).alias("t_ts"), "_t.*").drop("_t", "_late"))


_LAST_TOUCH_OUT = [
    ("order_id", "shopifyOrderId"), ("o_shop", "shopifyShopURL"),
    ("o_processed_at", "shopifyOrderProcessedAt"), ("o_price", "shopifyOrderTotalPrice"),
    ("attribution_source", "attribution_source"), ("t_referrer", "pageReferrer"),
    ("t_medium", "utmMedium"), ("t_campaign", "utmCampaign"), ("match_type", "match_type"),
    ("t_ts", "touchpoint_timestamp"),
]


def last_touch(events: DataFrame, days: int = 90, keys: Sequence[str] = KEYS_WITH_SHOP,
               order_key: Sequence[str] = ("order_id",), epoch_unit: str = "s",
               strict: bool = False, touches: Column | None = None) -> DataFrame:
    """Last touch inside the lookback window, one row per order key.

    Equivalent to ``ROW_NUMBER() OVER (PARTITION BY order ORDER BY touch ts
    DESC, touch id, order event id) = 1`` over the filtered journey, but
    computed with aggregates so that neither the pair relation nor a whole
    order group is ever built:

    * When the match keys include the timestamp, every touch of an order
      event has the order's timestamp, so the winner for every order event
      of one key group is the same touch: the one with the lowest id.  It
      is taken per key group first (``min`` of a struct, partial-aggregated
      map-side), then joined to the order events -- one row per order event.
    * Otherwise (identity keys such as the user) ``as_of_touches`` scans one
      stream of orders and touches and finds the last touch of each order event.
    * Finally ``min_by`` per order key picks the latest touch across that
      order's events.

    Ties go by touch id, then by the values shown, then by order event; no
    step needs an event id.  ``strict`` takes touches before the order only
    (an order event is a touch of itself otherwise, so no window can then cut
    anything); ``touches`` restricts which events count as touches.
    """
    if "timestamp" in keys:
        if strict:
            raise ValueError("keys with the timestamp admit no earlier touch")
        o = order_events(events)
        t = touchpoints(events if touches is None else events.filter(touches))
        tkeys = [_KEY_COLS[k][1] for k in keys]
        rest = [c for c in t.columns if c not in tkeys]
        best = (t.filter(F.col("t_ts").isNotNull()).groupBy(*tkeys)
                .agg(F.min_by(F.struct(*rest), F.struct(*[c for c in _TOUCH_RANK if c in rest]))
                     .alias("_best")))
        best = best.select(*tkeys, "_best.*")
        per_order_event = o.join(best, _key_condition(o, best, keys))
    else:
        per_order_event = as_of_touches(events, keys, epoch_unit, strict, touches)
    cand = (per_order_event
            .filter((F.col("t_ts") <= F.col("o_ts"))
                    & (within_lookback("t_ts", "o_ts", days, epoch_unit) == 1))
            .withColumn("match_type",
                        match_type("o_user", "t_user", "o_ip", "t_ip", "o_ts", "t_ts")))
    rank = _touch_rank(*_ORDER_RANK)
    keep = [src for src, _ in _LAST_TOUCH_OUT]
    win = F.min_by(F.struct(*keep), rank).alias("_w")
    okeys = [_ORDER_KEY_ALIASES.get(k, k) for k in order_key]
    return (cand.groupBy(*okeys).agg(win)
            .select(*[F.col(f"_w.{src}").alias(dst) for src, dst in _LAST_TOUCH_OUT]))


_STATE_KEY = ("ip", "timestamp", "shopifyShopURL")


def last_touch_state(events: DataFrame) -> DataFrame:
    """What later logs need to know of this one to keep ``last_touch`` (keys
    ``KEYS_WITH_SHOP``) current: per key its best touch, per order and key its
    first order event.  States of parts of a log are merged by ``min``, in any
    order and any number of times (``merged_state``)."""
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(_STATE_KEY)]
    whole = F.lit(True)
    for c in _STATE_KEY:
        whole = whole & F.col(c).isNotNull()
    touch = F.struct((-F.col("timestamp")).alias("_late"), *_touch_values())
    by_name = {v: F.col(k) for k, v in _ORDER_SIDE.items()}
    names = [*_ORDER_RANK, *[c for c in by_name if c not in _ORDER_RANK]]
    order = F.struct(*[by_name[c].alias(c) for c in names])
    stream = events.filter(whole).select(
        *key, touch.alias("touch"), F.when(F.col("shopifyOrderId").isNotNull(), order).alias("order"))
    # An event is a touch and, with an order id, a row of its order as well.
    rows = stream.select("k0", "k1", "k2", F.inline(F.filter(F.array(
        F.struct(F.lit(None).cast("string").alias("order_id"), F.col("touch"), F.lit(None).alias("order")),
        F.struct(F.col("order.order_id").alias("order_id"), F.lit(None).alias("touch"), F.col("order"))),
        lambda x: x["touch"].isNotNull() | x["order"].isNotNull())))
    return merged_state(rows)


def merged_state(parts: DataFrame) -> DataFrame:
    """One state of the union of several (partial aggregates: a heavy key is
    reduced before the shuffle)."""
    return parts.groupBy("order_id", "k0", "k1", "k2").agg(F.min("touch").alias("touch"), F.min("order").alias("order"))


def last_touch_of_state(state: DataFrame) -> DataFrame:
    """``last_touch`` of the log behind a merged state.  The touch has the
    order event's own time, so no window cuts it."""
    t = state.filter(F.col("order_id").isNull()).select("k0", "k1", "k2", "touch")
    o = state.filter(F.col("order_id").isNotNull()).select(
        F.col("k0").alias("o0"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), "order")
    met = o.join(t, [o[f"o{i}"] == t[f"k{i}"] for i in range(3)])
    flat = met.select("order.*", F.col("k1").alias("t_ts"), "touch.*").drop("_late")
    flat = flat.withColumn("match_type", match_type("o_user", "t_user", "o_ip", "t_ip", "o_ts", "t_ts"))
    keep = [src for src, _ in _LAST_TOUCH_OUT]
    win = F.min_by(F.struct(*keep), _touch_rank(*_ORDER_RANK)).alias("_w")
    return (flat.groupBy("order_id").agg(win)
            .select(*[F.col(f"_w.{src}").alias(dst) for src, dst in _LAST_TOUCH_OUT]))


def attribution_report(last: DataFrame, ordered: bool = True) -> DataFrame:
    """Orders and revenue by store, month, source, referrer, medium, campaign.

    ``last`` holds one row per order key (``last_touch``), so the distinct
    order count of a group equals its row count; plain ``count`` keeps the
    aggregate partial (map-side) instead of shuffling every order id.
    Revenue is summed as DECIMAL(38,10), rounded once to cents, and returned
    as DOUBLE.
    """
    out = (last.groupBy(
        F.col("shopifyShopURL").alias("STORE"),
        month_start_date(F.col("shopifyOrderProcessedAt")).alias("MONTH"),
        F.col("attribution_source").alias("ATTRIBUTION_SOURCE"),
        F.col("pageReferrer").alias("PAGEREFERRER"),
        F.coalesce(F.col("utmMedium"), F.lit("none")).alias("MEDIUM"),
        F.coalesce(F.col("utmCampaign"), F.lit("none")).alias("CAMPAIGN"))
        .agg(F.count("shopifyOrderId").alias("ATTRIBUTED_ORDERS"),
             F.round(F.sum(F.col("shopifyOrderTotalPrice").cast("decimal(38,10)")), 2)
             .cast("double").alias("ATTRIBUTED_REVENUE")))
    if ordered:
        out = out.orderBy(F.col("STORE"), F.col("MONTH"), F.col("ATTRIBUTED_ORDERS").desc())
    return out


_STEP_ORDER = ("t_ts", *_TOUCH_RANK, *_ORDER_RANK)
_COUNT_RANK = _TOUCH_RANK[:2]     # what ranks touches where steps are counted by source
PIECE_IDS = 65_536
PIECE_DAYS = 86_400
ALIKE_IPS = 64        # ips of an order at one time, up to which it is compared with others


class _Ranks:
    """Places of touches and order events under ``KEYS_NO_SHOP``, from which
    journey steps are composed without sorting pairs.

    All touches of a pair share the order event's time, so an order's steps go
    by time first.  Where the order has one ip at a time, the touches of that
    (ip, time) come in rank order, and for each of them the order's events
    there: the step is the number of the order's pairs at earlier times, plus
    (touch place - 1) x (order events there), plus the order event's place.
    Times at which an order has several ips (``many``) interleave their
    touches; their pairs alone are numbered as pairs.

    The log is read and exchanged once, by (ip, time, piece of event ids), so a
    heavy (ip, time) is cut; order events go by (order, day), so a heavy order
    is cut too.  Per-piece and per-day counts give the offsets.  Nothing is
    persisted or checkpointed.  Copies of one touch follow each other.

    ``counting`` keeps only what counts by step and source tell apart: touches
    of one id and source take the same steps in whatever order they stand, and
    so do the order events of one order, ip and time.
    """

    def __init__(self, events: DataFrame, epoch_unit: str = "s", counting: bool = False):
        values, rank, side, order_rank = _touch_values(), _TOUCH_RANK, _ORDER_SIDE, _ORDER_RANK
        if counting:
            values, rank, order_rank = values[:len(_COUNT_RANK)], _COUNT_RANK, ("o_ip",)
            side = {k: v for k, v in side.items() if v in ("order_id", "o_ts", "o_ip")}
        order = F.struct(*[F.col(k).alias(v) for k, v in side.items()])
        piece = F.coalesce(F.floor(F.col("event_id") / F.lit(PIECE_IDS)), F.lit(-(1 << 62)))
        stream = events.filter(F.col("ip").isNotNull() & F.col("timestamp").isNotNull()).select(
            F.col("ip").alias("ip"), F.col("timestamp").alias("ts"), piece.cast("bigint").alias("piece"),
            F.struct(*values).alias("touch"),
            F.when(F.col("shopifyOrderId").isNotNull(), order).alias("order"))
        at = ["ip", "ts", "piece"]
        dealt = dealt_once(stream, at)
        kat = [f"_k_{c}" for c in at]
        counts = dealt.groupBy(*kat).agg(F.sum(inside(lambda r: F.lit(1).cast("bigint"))).alias("n"))
        key = Window.partitionBy("_k_ip", "_k_ts")
        before = key.orderBy("_k_piece").rowsBetween(Window.unboundedPreceding, -1)
        places = counts.select(*[F.col(c).alias(f"p{c}") for c in kat], F.sum("n").over(key).alias("m"),
                               F.coalesce(F.sum("n").over(before), F.lit(0)).alias("t_before"))
        local = Window.partitionBy(*kat).orderBy(*[F.col(f"touch.{c}") for c in rank])
        rows = unpacked(dealt).withColumn("_here", F.row_number().over(local))
        rows = merge_join(rows, places, [rows[c] == places[f"p{c}"] for c in kat])
        t = rows.select("ip", "ts", "touch.*", (F.col("_here") + F.col("t_before")).alias("place"))
        # Both kinds of pairs read one exchange of the touches, and one of the orders.
        self.touches = unpacked(dealt_once(t, ["ip", "ts"])).drop("ip", "ts").withColumnsRenamed(
            {"_k_ip": "t_ip_", "_k_ts": "t_ts"})

        day = F.floor(F.col("o_ts") / F.lit(PIECE_DAYS * UNITS_PER_SECOND[epoch_unit])).alias("day")
        o = rows.filter(F.col("order").isNotNull()).select("order.*", "m").select("*", day)
        days = dealt_once(o, ["order_id", "day"])
        xday = ["_k_order_id", "_k_day"]
        per_day = days.groupBy(*xday).agg(F.sum(inside(lambda r: r["m"])).alias("n"))
        earlier = Window.partitionBy("_k_order_id").orderBy("_k_day").rowsBetween(Window.unboundedPreceding, -1)
        per_day = per_day.select(*[F.col(c).alias(f"d{c}") for c in xday],
                                 F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("d_before"))
        in_day, moment = Window.partitionBy(*xday), Window.partitionBy(*xday, "o_ts")
        here = Window.partitionBy(*xday, "o_ts", "o_ip")
        o = unpacked(days).select(
            "*", F.coalesce(F.sum("m").over(in_day.orderBy("o_ts").rangeBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)).alias("in_day"),
            (F.min("o_ip").over(moment) != F.max("o_ip").over(moment)).alias("many"),
            F.count(F.lit(1)).over(here).alias("k"),
            F.row_number().over(here.orderBy(*order_rank)).alias("o_place"))
        o = merge_join(o, per_day, [o[c] == per_day[f"d{c}"] for c in xday]).select(
            *side.values(), "k", "many", "o_place", (F.col("in_day") + F.col("d_before")).alias("offset"))
        self.orders = unpacked(dealt_once(o, ["o_ip", "o_ts"])).drop("_k_o_ip", "_k_o_ts")

    def _pairs(self, which: Column) -> DataFrame:
        o, t = self.orders.filter(which), self.touches
        return merge_join(o, t, [o["o_ip"] == t["t_ip_"], o["o_ts"] == t["t_ts"]])

    def interleaved(self) -> DataFrame:
        """Steps of the pairs at times where an order has several ips."""
        moment = Window.partitionBy("order_id", "o_ts").orderBy(*_TOUCH_RANK, "place", *_ORDER_RANK)
        return self._pairs(F.col("many")).withColumn(
            "TOUCHPOINT_STEP", F.col("offset") + F.row_number().over(moment))

    def interleaved_alike(self) -> DataFrame:
        """The places (order, time) of ``interleaved``, one row per ip with its
        number of order events; those that stand alike -- same time, offset and
        events at the same ips -- are one place with a count.  A place of more
        than ``ALIKE_IPS`` ips stays by itself, so no list of ips grows large."""
        o = self.orders.filter(F.col("many") & (F.col("o_place") == 1)).select(
            "order_id", "o_ts", "offset", "o_ip", "k",
            F.count(F.lit(1)).over(Window.partitionBy("order_id", "o_ts")).alias("ips"))
        few = o.filter(F.col("ips") <= ALIKE_IPS).groupBy("order_id", "o_ts", "offset").agg(
            F.sort_array(F.collect_list(F.struct("o_ip", "k"))).alias("stand"))
        few = few.groupBy("o_ts", "offset", "stand").agg(
            F.min("order_id").alias("order_id"), F.count(F.lit(1)).alias("orders"))
        names = ["order_id", "o_ts", "offset", "orders", "o_ip", "k"]
        return (few.select("order_id", "o_ts", "offset", "orders", F.inline("stand")).select(*names)
                .unionByName(o.filter(F.col("ips") > ALIKE_IPS)
                             .withColumn("orders", F.lit(1).cast("bigint")).select(*names)))

    def composed(self) -> DataFrame:
        return self._pairs(~F.col("many")).withColumn(
            "TOUCHPOINT_STEP", F.col("offset") + (F.col("place") - 1) * F.col("k") + F.col("o_place"))


def touch_journey(events: DataFrame, keys: Sequence[str] = KEYS_NO_SHOP,
                  ordered: bool = True, n_buckets: int | None = None,
                  epoch_unit: str = "s") -> DataFrame:
    """Every touch of every order with its step number (1 = earliest).

    Steps count across all events of an order id, ordered by touch time,
    then touch id, then all that the rows hold, then order event, so the order
    is total up to equal rows.  With ``KEYS_NO_SHOP`` steps are composed from
    places (``_Ranks``) and pairs are only emitted; other keys number the pairs
    through the range-bucketed ``row_number_within``.
    """
    if tuple(keys) == KEYS_NO_SHOP:
        ranks = _Ranks(events, epoch_unit)
        out = _steps(ranks.composed()).unionByName(_steps(ranks.interleaved()))
    else:
        pairs = journey(events, keys, epoch_unit=epoch_unit).select("order_id", *_STEP_ORDER)
        out = _steps(row_number_within(pairs, ["order_id"], list(_STEP_ORDER),
                                       out="TOUCHPOINT_STEP", n_buckets=n_buckets))
    return out.orderBy("SHOPIFYORDERID", "TOUCHPOINT_STEP") if ordered else out


def step_counts(events: DataFrame, below: int | None = None, epoch_unit: str = "s") -> DataFrame:
    """Distinct orders by (step, source) of ``touch_journey``, with no row per
    order and touch.

    A step number occurs once per order, so orders are counted, not told apart:
    those that stand alike at an (ip, time) -- same offset, same number of
    events there -- are one row with a count, and each touch is multiplied by
    it.  Times at which an order has several ips are counted in the same way
    (``interleaved_alike``): a touch's steps end with the sum of the order events
    that the touches up to it meet.  ``below`` keeps steps under it and drops
    what starts later early.
    """
    ranks = _Ranks(events, epoch_unit, counting=True)
    # One row per order and (ip, time).
    g = ranks.orders.filter(~F.col("many") & (F.col("o_place") == 1))
    t, tangled = ranks.touches, ranks.interleaved_alike()
    if below is not None:
        g, t = g.filter(F.col("offset") < below - 1), t.filter(F.col("place") < below)
        tangled = tangled.filter(F.col("offset") < below - 1)
    alike = g.groupBy("o_ip", "o_ts", "offset", "k").agg(F.count(F.lit(1)).alias("orders"))
    met = merge_join(alike, t, [alike["o_ip"] == t["t_ip_"], alike["o_ts"] == t["t_ts"]])
    steps = met.groupBy("offset", "place", "k", "attribution_source").agg(F.sum("orders").alias("orders")).select(
        "attribution_source", "orders", F.explode(F.sequence(
            F.col("offset") + (F.col("place") - 1) * F.col("k") + 1,
            F.col("offset") + F.col("place") * F.col("k"))).alias("step"))
    up_to = (Window.partitionBy("order_id", "o_ts").orderBy(*_COUNT_RANK, "t_ip_", "place")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    apart = merge_join(tangled, t, [tangled["o_ip"] == t["t_ip_"], tangled["o_ts"] == t["t_ts"]]).select(
        "attribution_source", "orders", "k", (F.col("offset") + F.sum("k").over(up_to)).alias("last"))
    apart = apart.select("attribution_source", "orders", F.explode(F.sequence(
        F.col("last") - F.col("k") + 1, F.col("last"))).alias("step"))
    both = steps.unionByName(apart)
    if below is not None:
        both = both.filter(F.col("step") < below)
    return (both.groupBy(F.col("step").cast("bigint").alias("TOUCHPOINT_STEP"),
                         F.col("attribution_source").alias("ATTRIBUTION_SOURCE"))
            .agg(F.sum("orders").alias("ORDER_COUNT")))


def _steps(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("order_id").alias("SHOPIFYORDERID"),
                           F.col("o_shop").alias("SHOPIFYSHOPURL"),
                           F.col("TOUCHPOINT_STEP").cast("bigint").alias("TOUCHPOINT_STEP"),
                           F.col("attribution_source").alias("ATTRIBUTION_SOURCE"))


def first_steps(events: DataFrame, below: int = 10,
                keys: Sequence[str] = KEYS_NO_SHOP) -> DataFrame:
    """``touch_journey`` cut to steps under ``below``, without its pairs.

    With keys that hold the timestamp, a pair among an order's first n can
    only use one of its key's first n touches.  Those are kept before the
    join (Spark cuts each task's groups to n rows before the shuffle), so
    every order event meets n touches at most.
    """
    if "timestamp" not in keys:
        raise ValueError("the keys must hold the timestamp")
    n = below - 1
    t = touchpoints(events)
    tkeys = [_KEY_COLS[k][1] for k in keys]
    rank = [c for c in _TOUCH_RANK if c not in tkeys]
    t = (t.withColumn("_k", F.row_number().over(Window.partitionBy(*tkeys).orderBy(*rank)))
         .filter(F.col("_k") <= n).drop("_k"))
    o = order_events(events)
    step = F.row_number().over(Window.partitionBy("order_id").orderBy(*_STEP_ORDER))
    pairs = o.join(t, _key_condition(o, t, keys)).filter(F.col("t_ts") <= F.col("o_ts"))
    return _steps(pairs.withColumn("TOUCHPOINT_STEP", step).filter(F.col("TOUCHPOINT_STEP") <= n))
