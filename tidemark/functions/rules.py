"""Row rules as column functions: piecewise scores, labels, prices, chances and expectations. Null stays null unless told otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clip

#: Fixed values of the rules, as the published game and the model's authors set them.
DEFENDER_LINE, OTHER_LINE = 10, 12
CARD_POINTS = (-1.0, -3.0)
XI_BOUNDS = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
FIELD_HIGH, FIELD_LOW = 40.0, 15.0
DIFFERENTIAL, TEMPLATE = 0.30, 0.70
RETURNS_NOW = 50.0
RECOVERY = 0.7
PEN_XG, PEN_LEAST = 0.79, 0.5
FULL_MATCH = 90
GOAL_POINTS = {"GKP": 10.0, "DEF": 6.0, "MID": 5.0, "FWD": 4.0}
PEN_CONVERSION, PENS_PER_GAME = 0.78, 0.13
ATTACK_BOUNDS, PEN_EP_BOUNDS = (0.6, 1.6), (-0.3, 0.8)
HOME_EDGE = 60.0


def order_score(order: Column) -> Column:
    """First in an order 1, second a half, later 0; anything under 1 is unknown."""
    return F.when(order == 1, 1.0).when(order == 2, 0.5).when(order >= 3, 0.0)


def adjusted_points(points: Column, count: Column, old: Column) -> Column:
    """Points of rows under the old rule (a point for two) as the new one (a point for three) gives them."""
    n = F.coalesce(count, F.lit(0))
    return points + F.when(old, F.floor(n / 3) - F.floor(n / 2)).otherwise(0)


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")))


def mode_label(minutes: Column, starts: Column) -> Column:
    """0 did not play, 1 came on, 2 started; unknown starts follow from an hour played."""
    played = F.coalesce(minutes, F.lit(0))
    return F.when((played > 0) & (start_truth(minutes, starts) >= 1), 2).when(played > 0, 1).otherwise(0).cast("bigint")


def start_truth(minutes: Column, starts: Column) -> Column:
    return F.coalesce(starts.cast("double"), (F.coalesce(minutes, F.lit(0)) >= 60).cast("double"))


def threshold_hit(defender: Column, tackles: Column, blocks: Column, recoveries: Column) -> Column:
    """1 where a defender's tackles and blocks, or another's with recoveries too, reach the line."""
    zero = F.lit(0)
    two = F.coalesce(tackles, zero) + F.coalesce(blocks, zero)
    own = F.coalesce(defender, F.lit(False))
    return F.when(own, two >= DEFENDER_LINE).otherwise(two + F.coalesce(recoveries, zero) >= OTHER_LINE).cast("bigint")


def card_penalty(rates: Sequence[tuple[Column, Column]]) -> Column:
    """Points lost to cards: of each card the shrunken rate, else the raw one, else none."""
    total = F.lit(0.0)
    for (shrunk, raw), points in zip(rates, CARD_POINTS, strict=True):
        total = total + points * F.coalesce(shrunk, raw, F.lit(0.0))
    return total


def sell_price(bought: Column, now: Column) -> Column:
    """Half of a rise, rounded down, is kept; a fall counts whole."""
    return F.when(now <= bought, now).otherwise(bought + F.floor((now - bought) / 2))


def return_chance(return_slot: Column, slot: Column) -> Column:
    return F.when(return_slot > slot, 0.0).when(return_slot <= slot, RETURNS_NOW)


def field_class(owned: Column, eo: Column) -> Column:
    """What an asset is against the field: shield or sword if owned, else threat."""
    return F.when(owned & (eo >= FIELD_HIGH), "shield").when(owned & (eo <= FIELD_LOW), "sword").when(~owned & (eo >= FIELD_HIGH), "threat")


def transfer_tag(eo_pct: Column, has_strategy: Column) -> Column:
    eo = F.coalesce(eo_pct, F.lit(0.0)) / 100
    return F.when(~has_strategy, "").when(eo < DIFFERENTIAL, "attack").when(eo >= TEMPLATE, "cover").otherwise("")


def direction(change: Column) -> Column:
    return F.when(change > 0, "rise").when(change < 0, "drop").when(change == 0, "flat")


def cover_from_eo(eo_pct: Column) -> Column:
    return clip(eo_pct / 100, high=1.0)


def tilt(ep: Column, cover: Column, dial: Column) -> Column:
    """Expected points towards (dial above 0) or away from what others don't cover; a dial of 0 changes nothing."""
    held = F.coalesce(clip(cover, 0.0, 1.0), F.lit(0.0))
    return F.when(dial == 0, ep).otherwise(ep * (1 + dial * (1 - held)) / (1 + F.greatest(dial, F.lit(0.0))))


def remaining_fraction(minutes: Column, started: Column, finished: Column, fixtures: Column, unplayed: Column) -> Column:
    """Share of a slot's expectation still to come."""
    in_play = F.greatest(F.lit(0.0), 1 - F.coalesce(minutes, F.lit(0)) / FULL_MATCH)
    left = (F.coalesce(unplayed, F.lit(0)) + in_play) / F.greatest(F.lit(1), F.coalesce(fixtures, F.lit(1)))
    return F.when(finished, 0.0).when(~started, 1.0).otherwise(F.least(F.lit(1.0), left))


def event_estimate(total: Column, open_play: Column, most: int = 2) -> Column:
    """How many rare events of PEN_XG each a gap between two totals holds, the first from PEN_LEAST on; none where either is unknown."""
    gap = F.greatest(F.lit(0.0), F.coalesce(total - open_play, F.lit(0.0)))
    return F.least(F.floor((gap + (PEN_XG - PEN_LEAST)) / PEN_XG), F.lit(most)).cast("bigint")


def returned(curve: Column, pooled: Column, steps: Column) -> Column:
    """Chance of being back after so many steps: the type's curve, else the pooled one, its last value held; null without either."""
    known = F.when(F.size(curve) > 0, curve).when(F.size(pooled) > 0, pooled)
    return F.get(known, F.least(steps.cast("int"), F.size(known) - 1))


def relaxed(factor: Column, steps: Column, typed: Column, curve: Column, pooled: Column, slot: Column, return_slot: Column) -> Column:
    """A factor of availability so many steps on: 0 before a known return, else moved towards 1 by the curve, or by RECOVERY a step where no type is known."""
    back = F.when(typed.isNotNull(), returned(curve, pooled, steps))
    later = 1 - (1 - factor) * F.coalesce(1 - back, F.pow(F.lit(RECOVERY), steps))
    return F.when(slot < return_slot, 0.0).when(steps <= 0, factor).otherwise(later)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """By formula 26.2.17 of Abramowitz and Stegun, within 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = normal_pdf(z) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def gap_win_probability(mine: Column, theirs: Column, slots: Column, sigma: float) -> Column:
    """That a lead outlasts so many slots of normal noise of both sides."""
    sure = (mine >= theirs).cast("double")
    return F.when(slots <= 0, sure).otherwise(normal_cdf((mine - theirs) / (sigma * F.sqrt(2 * F.greatest(slots, F.lit(1))))))


def goal_points(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, points in GOAL_POINTS.items():
        out = F.when(kind == name, points).otherwise(out)
    return out


def penalty_increment(now: Column, before: Column, attack: Column, points: Column, plays: Column) -> Column:
    """Goals to add for a change of a taker's share, (goals, ep), scaled so that plays x goals x points is the bounded ep."""
    goals = (F.coalesce(now, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))) * PENS_PER_GAME * clip(F.coalesce(attack, F.lit(1.0)), *ATTACK_BOUNDS) * PEN_CONVERSION
    raw = goals * points * F.coalesce(plays, F.lit(0.0))
    ep = clip(raw, *PEN_EP_BOUNDS)
    return F.struct(F.when(raw == 0, 0.0).otherwise(goals * ep / raw).alias("goals"), ep.alias("ep"))


def expected_score(own: Column, other: Column, home: Column) -> Column:
    """By Elo's logistic curve, with the edge of playing at home."""
    return 1 / (1 + F.pow(F.lit(10.0), -(own + F.when(home, HOME_EDGE).otherwise(0.0) - other) / 400))


def rescaled_modes(absent: Column, calibrated: Column, sub: Column, start: Column) -> Column:
    """(absent, sub, start) with the calibrated chance of absence: the other two keep their ratio; without any mass of theirs, what is freed goes to sub."""
    rest = 1 - absent
    wide = rest > 1e-12
    scale = F.when(wide, (1 - calibrated) / F.when(wide, rest)).otherwise(1.0)
    return F.struct(calibrated.alias("absent"), (sub * scale + F.when(wide, 0.0).otherwise(1 - calibrated)).alias("sub"), (start * scale).alias("start"))


def first_date(text: Column, *formats: str) -> Column:
    """The date by the first format that reads the text, null if none does; two-digit years from 69 on are of the last century."""
    found = [(f, F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f in formats]
    century = lambda f, t: F.when(F.year(t) > 2068, F.add_months(t, -1200)).otherwise(t) if "yyyy" not in f else t
    return F.coalesce(*[century(f, t) for f, t in found])
