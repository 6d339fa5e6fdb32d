"""What a caller declares: adapters of features, grammars, works and question handlers. All functions give columns, so a plan stays one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus


@dataclass(frozen=True)
class Adapter:
    """How rows of a source become records: features by name, the key they are told apart by, and where they come from."""

    schema: str
    features: Mapping[str, Callable[[], Column]]
    key: Callable[[], Column]
    source: Callable[[], Column]

    def records(self, rows: DataFrame) -> DataFrame:
        context = F.struct(*[make().alias(name) for name, make in self.features.items()])
        return rows.select(F.lit(self.schema).alias("schema"), self.key().alias("key"), context.alias("context"), self.source().alias("source"))


@dataclass(frozen=True)
class Grammar:
    """A grammar: construction_of gives a text's construction or null, is_consistent judges a label, read gives readings."""

    construction_of: Callable[[Column], Column]
    is_consistent: Callable[[Column, Column], Column]
    read: Callable[[DataFrame], DataFrame] | None = None
    probe: str = ""
    provenance: str = ""


def audited(rows: DataFrame, grammars: Mapping[str, Grammar], grammar: str, text: str, label: str) -> DataFrame:
    """rows with construction and consistent as their own grammar says; both null for a grammar that is not registered."""
    construction = consistent = F.lit(None)
    for name, g in grammars.items():
        own = F.col(grammar) == name
        construction = F.when(own, g.construction_of(F.col(text))).otherwise(construction)
        consistent = F.when(own, g.is_consistent(F.col(text), F.col(label))).otherwise(consistent)
    return rows.withColumn("construction", construction.cast("string")).withColumn("consistent", consistent.cast("boolean"))


@dataclass(frozen=True)
class Work:
    """What a work's configuration says of its discovery and of what is dropped from its pages."""

    discovery: str = "single"
    drop_titles: list[str] = field(default_factory=list)
    drop_elements: list[str] = field(default_factory=list)
    drop_lines: str | None = None
    exclude: str | None = None


def configured(pages: DataFrame, works: Mapping[str, Work], work: str, title: str, text: str) -> DataFrame:
    """Pages of configured works without excluded ones and dropped titles, their text without dropped elements and lines."""
    keep, cleaned = F.lit(False), F.col(text)
    for name, w in works.items():
        own = F.col(work) == name
        t, ok = F.col(text), F.lit(True)
        if w.drop_elements:
            t = corpus.drop_elements(t, w.drop_elements)
        if w.drop_lines:
            t = corpus.drop_lines(t, w.drop_lines)
        if w.drop_titles:
            ok = ok & ~F.coalesce(F.col(title).isin(w.drop_titles), F.lit(False))
        if w.exclude:
            ok = ok & ~F.coalesce(F.col(title).rlike(w.exclude), F.lit(False))
        keep, cleaned = F.when(own, ok).otherwise(keep), F.when(own, t).otherwise(cleaned)
    return pages.where(keep).withColumn(text, cleaned)


def answered(questions: DataFrame, handlers: Mapping[str, Callable[[], Column]], kind: str) -> DataFrame:
    """questions with answer, from the handler of their kind, and known, false for kinds without one."""
    answer = F.lit(None).cast("string")
    for name, handler in handlers.items():
        answer = F.when(F.col(kind) == name, handler().cast("string")).otherwise(answer)
    return questions.withColumn("answer", answer).withColumn("known", F.coalesce(F.col(kind).isin(*handlers), F.lit(False)))
