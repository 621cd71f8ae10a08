"""Query vectors of segments, in the coordinates of ``features.behavior_vector_v2``.

Compiled on the driver: a vector has 64 numbers, and becomes a literal of the search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from ..functions.text import DESTINATION_ALIASES
from .features import query_vector

# Blocks of a vector, the signals a query may set, and per candidate type its signals, block weights and hard predicates.
BLOCKS = {"funnel": (0, 15), "destination": (16, 31), "timing": (32, 39), "benefit": (40, 47), "promotion_response": (48, 55), "derived": (56, 63)}
SIGNALS = {
    "hotel_search_intensity": 1, "hotel_click_intensity": 2, "hotel_detail_view_intensity": 3, "booking_start_intensity": 4, "booking_start_without_complete": 14, "hotel_consideration_intensity": 15,
    "spring_checkin_share": 32, "summer_checkin_share": 33, "fall_checkin_share": 34, "winter_checkin_share": 35,
    "deal_interest_intensity": 40, "price_interest_intensity": 42, "free_cancellation_interest": 45, "breakfast_interest": 46, "benefit_breadth": 47,
    "promotion_impression_intensity": 48, "promotion_click_intensity": 49, "campaign_redirect_intensity": 50, "campaign_landing_intensity": 51, "promotion_click_rate": 52, "campaign_landing_rate": 53, "promotion_response_intensity": 55,
    "has_hotel_interest": 56, "single_destination_concentration": 57, "destination_breadth": 58, "has_booking_abandonment": 59, "has_promotion_response": 60, "has_benefit_interest": 61, "engagement_composite": 63,
}
CANDIDATE_SIGNALS = {
    "intent_matched": ("hotel_search_intensity", "hotel_detail_view_intensity", "hotel_consideration_intensity", "has_hotel_interest", "engagement_composite"),
    "target_destination_affinity": ("hotel_search_intensity", "hotel_detail_view_intensity", "hotel_consideration_intensity", "single_destination_concentration", "engagement_composite"),
    "funnel_recovery": ("hotel_detail_view_intensity", "booking_start_intensity", "booking_start_without_complete", "has_booking_abandonment", "engagement_composite"),
    "benefit_value_seeker": ("hotel_search_intensity", "deal_interest_intensity", "price_interest_intensity", "free_cancellation_interest", "breakfast_interest", "benefit_breadth", "has_benefit_interest"),
    "promotion_responsive": ("promotion_impression_intensity", "promotion_click_intensity", "campaign_redirect_intensity", "campaign_landing_intensity", "promotion_click_rate", "campaign_landing_rate", "promotion_response_intensity", "has_promotion_response"),
    "general_destination_explorer": ("hotel_search_intensity", "hotel_click_intensity", "hotel_detail_view_intensity", "hotel_consideration_intensity", "destination_breadth", "engagement_composite"),
}
BLOCK_WEIGHTS = {
    "intent_matched": {"funnel": 0.35, "destination": 0.35, "timing": 0.15, "derived": 0.15},
    "target_destination_affinity": {"destination": 0.6, "funnel": 0.2, "derived": 0.2},
    "funnel_recovery": {"funnel": 0.55, "destination": 0.25, "derived": 0.2},
    "benefit_value_seeker": {"benefit": 0.5, "destination": 0.2, "funnel": 0.1, "derived": 0.2},
    "promotion_responsive": {"promotion_response": 0.65, "funnel": 0.1, "derived": 0.25},
    "general_destination_explorer": {"destination": 0.3, "funnel": 0.2, "derived": 0.5},
}
HARD = {
    "intent_matched": ("hotel_product_interest",),
    "target_destination_affinity": ("target_destination_affinity", "hotel_product_interest"),
    "funnel_recovery": ("booking_start_without_complete",),
    "benefit_value_seeker": ("benefit_interest",),
    "promotion_responsive": ("promotion_response",),
    "general_destination_explorer": ("general_destination_exploration",),
}
WITH_DESTINATION = ("intent_matched", "target_destination_affinity", "funnel_recovery", "benefit_value_seeker")
SEASONS = {"spring": "spring_checkin_share", "summer": "summer_checkin_share", "fall": "fall_checkin_share", "autumn": "fall_checkin_share", "winter": "winter_checkin_share"}
MONTHS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11), "winter": (12, 1, 2)}
BENEFITS = {"discount": ("deal_interest_intensity", "price_interest_intensity"), "early_booking": ("deal_interest_intensity", "price_interest_intensity"), "free_cancellation": ("free_cancellation_interest",), "breakfast_included": ("breakfast_interest",)}


def destination_id(name: str) -> str:
    """The canonical id of a destination's spelling, as ``text.canonical_destination`` gives it to events."""
    plain = re.sub(r"\s+", " ", name.strip()).lower()
    return next((key for key, names in DESTINATION_ALIASES.items() if plain in names), plain)


def signed_coordinate(destination: str) -> tuple[int, float]:
    digest = hashlib.sha256(destination.encode()).digest()
    return BLOCKS["destination"][0] + int.from_bytes(digest[:8], "big") % 16, -1.0 if digest[8] % 2 else 1.0


def _signals(names: Sequence[str], destinations: Sequence[str], seasons: Sequence[str], benefits: Sequence[str]) -> dict[int, float]:
    unknown = sorted(set(names) - set(SIGNALS))
    if unknown:
        raise ValueError("unknown signals: " + ", ".join(unknown))
    found = {SIGNALS[n]: 1.0 for n in names}
    if benefits:
        # what was asked for stands in place of the type's own benefits
        for own in BENEFITS.values():
            for n in own:
                found.pop(SIGNALS[n], None)
        found |= {SIGNALS[n]: 1.0 for b in benefits for n in BENEFITS[b]}
    for d in dict.fromkeys(map(destination_id, destinations)):
        if d:
            index, sign = signed_coordinate(d)
            found[index] = found.get(index, 0.0) + sign
    return found | {SIGNALS[SEASONS[s]]: 1.0 for s in seasons}


def _weighted(signals: dict[int, float], weights: dict[str, float]) -> list[float]:
    total = sum(weights.values())
    v = query_vector(signals, BLOCKS, {b: w / total for b, w in weights.items()}) if total > 0 else []
    if not any(v):
        raise ValueError("a query needs an active block")
    return v


def candidate_query(kind: str, destinations: Sequence[str] = (), seasons: Sequence[str] = (), benefits: Sequence[str] = ()) -> list[float]:
    """The query of a candidate type for a promotion's destinations, seasons and benefits; unknown seasons and benefits are passed over."""
    if kind not in BLOCK_WEIGHTS:
        raise ValueError(f"unknown candidate type: {kind}")
    clean = lambda values: [v.strip().casefold() for v in values]
    wanted = [b for b in clean(benefits) if b in BENEFITS] if kind == "benefit_value_seeker" else []
    signals = _signals(CANDIDATE_SIGNALS[kind], destinations, [s for s in clean(seasons) if s in SEASONS], wanted)
    absent = {block for block, given in (("destination", destinations), ("timing", seasons)) if not given}
    return _weighted(signals, {b: w for b, w in BLOCK_WEIGHTS[kind].items() if b not in absent})


def candidate_predicates(kind: str, destinations: Sequence[str] = (), seasons: Sequence[str] = ()) -> list[str]:
    """Keys of the hard predicates that go with the query of a candidate type."""
    keys = list(HARD[kind])
    if destinations and kind in WITH_DESTINATION:
        keys.append("recent_destination_search")
    if seasons and kind == "intent_matched":
        keys.append("season_match")
    return keys


def segment_query(signals: Sequence[str], destinations: Sequence[str] = (), months: Sequence[int] = (), benefits: Sequence[str] = (), kind: str | None = None) -> list[float]:
    """The query of a segment as specified; its active blocks have the weights of ``kind``, or equal ones without."""
    seasons = [s for s, own in MONTHS.items() if set(own) & set(months)]
    found = _signals(signals, destinations, seasons, benefits)
    active = [b for b, (lo, hi) in BLOCKS.items() if any(lo <= i <= hi and x for i, x in found.items())]
    weights = BLOCK_WEIGHTS[kind] if kind else dict.fromkeys(active, 1.0)
    return _weighted(found, {b: w for b, w in weights.items() if b in active})
