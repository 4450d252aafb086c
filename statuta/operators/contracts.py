"""Contract clauses: labels, checklists, search texts and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.korean import split_articles
from statuta.functions.text import SPACE, strip

WHOLE = "전체 본문"
#: Words in a clause's heading that choose its checklist; the first that fits counts.
CHECKLISTS = (
    ("damages", ("손해배상", "위약금", "위약벌", "지연손해", "배상액")),
    ("termination", ("해지", "해제", "계약기간", "갱신", "존속기간")),
    ("jurisdiction", ("관할", "준거법", "분쟁해결", "중재")),
    ("confidentiality", ("비밀유지", "기밀", "보안")),
    ("liability", ("면책", "책임제한", "불가항력")),
    ("outsourcing", ("위탁", "수탁", "재위탁")),
)
DEFAULT = "default"
#: Labels of a review's fields, and the line before its references.
FIELDS = ("위험도:", "문제 조항:", "근거:", "수정 제안:")
REFERENCES = "**참고 문서**"


def clauses(contracts: DataFrame, id_col: str = "contract_id", text_col: str = "text") -> DataFrame:
    """(contract_id, pos, label, text); a contract without clauses is one as a whole."""
    parts = contracts.select(F.col(id_col).alias("contract_id"), F.col(text_col).alias("whole"), F.posexplode_outer(split_articles(F.col(text_col))).alias("pos", "part"))
    return parts.select("contract_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("part.label", F.lit(WHOLE)).alias("label"), F.coalesce("part.body", "whole").alias("text"))


def checklist(label: Column) -> Column:
    """Name of the checklist that a label's last parentheses choose."""
    heading = F.regexp_extract(label, rf"\(([^)]*)\){SPACE}*\z", 1)
    found = [F.when(heading.rlike("|".join(words)), name) for name, words in CHECKLISTS]
    return F.coalesce(*found, F.lit(DEFAULT))


def clause_query(label: Column, text: Column, name: Column) -> Column:
    """What is searched for a clause."""
    return F.format_string("[%s]\n%s\n(%s)", label, text, name)


def report_lines(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, field, content): non-blank lines, a known label taken off its line, rules left out."""
    lines = answers.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    bare = strip(F.col("line"))
    label = F.coalesce(*[F.when(bare.startswith(x), x) for x in FIELDS])
    kept = lines.where((bare != "") & (bare != "---")).withColumn("field", F.when(bare == REFERENCES, "참고 문서").otherwise(label))
    content = F.when(bare == REFERENCES, "").when(F.col("field").isNotNull(), F.substring(bare, F.length("field") + 1, F.length(bare))).otherwise(F.col("line"))
    return kept.select(id_col, "pos", "field", content.alias("content"))


def review_fields(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row an answer with its four fields."""
    lines = report_lines(answers, id_col, text_col)
    pick = lambda x: F.max(F.when(F.col("field") == x, strip(F.col("content"))))
    return lines.groupBy(id_col).agg(pick(FIELDS[0]).alias("risk"), pick(FIELDS[1]).alias("problem"), pick(FIELDS[2]).alias("grounds"), pick(FIELDS[3]).alias("proposal"))
