"""Destination names and term matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical destination ids and the spellings that mean them.
DESTINATION_ALIASES = {
    "jeju": ["jeju", "jeju-do", "jeju island", "제주", "제주도"],
    "seoul": ["seoul", "서울", "서울특별시"],
    "busan": ["busan", "부산", "부산광역시"],
    "gangneung": ["gangneung", "강릉", "강릉시"],
    "gyeongju": ["gyeongju", "경주", "경주시"],
    "incheon": ["incheon", "인천", "인천광역시"],
    "okinawa": ["okinawa", "오키나와"],
    "japan": ["japan", "일본", "도쿄", "오사카", "삿포로"],
    "sokcho": ["sokcho", "속초", "속초시"],
    "yeosu": ["yeosu", "여수", "여수시"],
}
# Spellings that a structured condition's destination also finds.
SEARCH_GROUPS = [
    ["제주", "jeju"],
    ["오키나와", "okinawa"],
    ["삿포로", "sapporo"],
    ["도쿄", "tokyo"],
    ["오사카", "osaka"],
    ["부산", "busan"],
    ["서울", "seoul"],
    ["다낭", "da nang", "danang"],
]


def normalized(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def canonical_destination(text: Column) -> Column:
    """The canonical id of a destination spelling; an unknown one is itself, normalised."""
    plain = normalized(text)
    pairs = [F.lit(x) for key, names in DESTINATION_ALIASES.items() for name in names for x in (name, key)]
    return F.coalesce(F.element_at(F.create_map(*pairs), plain), plain)


# What stands between the values of a list, beside the comma.
LIST_MARKS, OR_WORDS = ("，", "/", "·"), ("또는", "혹은")


def list_values(text: str, marks: Sequence[str] = (*LIST_MARKS, *OR_WORDS)) -> list[str]:
    """The distinct values of a written list, in lower case and order."""
    for mark in marks:
        text = text.replace(mark, ",")
    return sorted({v.strip().casefold() for v in text.split(",") if v.strip()})


def search_terms(destination: str) -> list[str]:
    """The destinations of a list and their other spellings in structured conditions; "or" words belong to a name here."""
    found = {own: next((g for g in SEARCH_GROUPS if own in g), [own]) for own in list_values(destination, LIST_MARKS)}
    return sorted({term for terms in found.values() for term in terms})


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term is in the text, in whatever case."""
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.instr(low, t) > 0) if terms else F.lit(False)


def split_values(text: Column) -> Column:
    """``list_values`` of a column."""
    parts = F.split(F.regexp_replace(text, "|".join((*LIST_MARKS, *OR_WORDS)), ","), ",")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
