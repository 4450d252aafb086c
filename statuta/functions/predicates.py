"""Predicates and small projections on documents: validity, visibility, types, authority, requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import strip

#: Document types in the order of their authority, with their labels.
AUTHORITY = {
    "law": (1, "법령 (강행규범)"),
    "regulation": (2, "사내규정 (내부 강행규범)"),
    "interpretation": (3, "유권해석 (감독당국 공식 해석)"),
    "case": (4, "제재사례 (집행 선례)"),
    "review": (5, "내부 검토서 (참고 의견, 구속력 없음)"),
    "faq": (6, "FAQ (내부 정리자료, 구속력 없음)"),
    "precedent": (7, "계약검토 선례 (내부 참고사례, 구속력 없음)"),
}
UNKNOWN_RANK = 8
TYPES = list(AUTHORITY)
ALL = "ALL"
#: Fixed value: edge types that a one-hop expansion follows.
EXPANDED = ("interprets", "violates", "cites", "related_to", "answered_by")


def qualified_id(kind: Column, external_id: Column) -> Column:
    return F.concat_ws(":", kind, external_id)


def type_from_id(entity_id: Column) -> Column:
    """The known type before the first colon, else null."""
    prefix = F.substring_index(entity_id, ":", 1)
    return F.when((F.instr(entity_id, ":") > 0) & prefix.isin(TYPES), prefix)


def visible(depts: Column, dept: Column) -> Column:
    return F.array_contains(depts, ALL) | F.array_contains(depts, dept)


def valid_at(effective: Column, superseded: Column, at: Column) -> Column:
    """Half-open validity; a missing bound is open."""
    return (effective.isNull() | (effective <= at)) & (superseded.isNull() | (at < superseded))


def type_allowed(types: Column, kind: Column) -> Column:
    return types.isNull() | F.array_contains(types, kind)


def authority_rank(kind: Column) -> Column:
    ranks = F.create_map(*[x for k, (rank, _) in AUTHORITY.items() for x in (F.lit(k), F.lit(rank))])
    return F.coalesce(F.try_element_at(ranks, kind), F.lit(UNKNOWN_RANK))


def authority_label(kind: Column) -> Column:
    labels = F.create_map(*[x for k, (_, label) in AUTHORITY.items() for x in (F.lit(k), F.lit(label))])
    return F.coalesce(F.try_element_at(labels, kind), kind)


def depts_to_text(depts: Column) -> Column:
    return F.array_join(depts, ",")


def depts_from_text(text: Column) -> Column:
    """Comma-joined departments; nothing means all."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(ALL))).otherwise(F.split(text, ","))


def parse_source_types(raw: Column) -> Column:
    """Known types among loosely written ones, each once; null where none is left."""
    clean = F.array_distinct(F.filter(F.transform(raw, lambda x: F.lower(strip(x))), lambda x: x.isin(TYPES)))
    return F.when(F.size(clean) > 0, clean)


def parse_top_k(raw: Column, default: int = 6) -> Column:
    return F.coalesce(F.nullif(raw, F.lit(0)), F.lit(default))


def require_departments(requests):
    """Refuse requests without a department: access rules cannot be skipped."""
    bad = F.raise_error(F.lit("a request needs a department"))
    return requests.withColumn("dept", F.when(F.coalesce(F.col("dept"), F.lit("")) == "", bad).otherwise(F.col("dept")))
