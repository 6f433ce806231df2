"""Fielded search as an immutable builder over a DataFrame.

    Search(docs).where(and_(match("question_body", "the"), from_to("uid", 1, 9))).boost(...).page(0, 10).run()

Filters and the scored query are separate: filters only select rows, query clauses also add to score.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import query_terms, tokens


def and_(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates)


def or_(*predicates: Column) -> Column:
    return reduce(Column.__or__, predicates)


def _bound(value):
    return None if value is None or value == "*" else F.lit(value)


def from_to(name: str, low, high) -> Column:
    """Inclusive range; None or '*' leaves an end open."""
    ends = [F.col(name) >= _bound(low)] * (_bound(low) is not None) + [F.col(name) <= _bound(high)] * (_bound(high) is not None)
    return reduce(Column.__and__, ends, F.col(name).isNotNull())


def from_(name: str, low) -> Column:
    return from_to(name, low, None)


def to_(name: str, high) -> Column:
    return from_to(name, None, high)


def match(name: str, text: str) -> Column:
    """Any word of text is a word of the field."""
    return F.arrays_overlap(tokens(F.col(name)), F.array(*[F.lit(w) for w in query_terms(text)]).cast("array<string>"))


def prefix(name: str, start: str) -> Column:
    """A word of the field begins with start."""
    return F.exists(tokens(F.col(name)), lambda w: F.startswith(w, F.lit(start.lower())))


def phrase(name: str, text: str) -> Column:
    """The words of text stand in the field one after another."""
    words = " ".join(text.lower().split())
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(name)), " "), F.lit(" ")), F.lit(f" {words} "))


def near(name: str, text: str) -> Column:
    """A word of the field begins with some word of text."""
    return reduce(Column.__or__, [prefix(name, w) for w in query_terms(text)], F.lit(False))


def boosted(predicate: Column, boost: float) -> Column:
    """Score of a clause."""
    return F.when(predicate, F.lit(float(boost))).otherwise(F.lit(0.0))


def iso_date(value: dt.datetime) -> str:
    """A moment as ISO text in UTC with a final Z."""
    value = value.astimezone(dt.UTC) if value.tzinfo else value
    return value.strftime("%Y-%m-%dT%H:%M:%SZ")


def date_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_value(text: Column) -> Column:
    """The moment of an ISO text with a final Z; null for any other text."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def product_of(question: str, products: list[str]) -> str | None:
    """First word of a question that is a product's whole name, case aside; the driver's side of detected_product()."""
    names = {p.lower() for p in products}
    return next((w for w in question.lower().split() if w in names), None)


def baseline(frame: DataFrame, question: str, products: list[str], answer: str = "answer_body", prefixes: bool = False, boosts: tuple[float, float, float] | None = None) -> Search:
    """Any word of a question in the title or in the answer, and the product that the question names, if it names one.

    With prefixes, words of the text that begin with a word of the question count too. With boosts (title,
    answer, product) the same rows come scored by the clauses that hold; the product is then a filter all the same.
    """
    name = product_of(question, products)
    held = near if prefixes else match
    parts = held("question_title", question), held(answer, question)
    found = Search(frame).where(or_(*[F.coalesce(p, F.lit(False)) for p in parts]))
    if name is not None:
        found = found.where(F.lower("product") == name)
    if boosts:
        sure = F.lit(name is not None)
        found = found.query(*[boosted(F.coalesce(p, F.lit(False)), b) for p, b in zip((*parts, sure), boosts)])
    return found


@dataclass(frozen=True)
class Search:
    """A query over one DataFrame; every method returns a new one. reset() is Search(frame)."""

    frame: DataFrame
    filters: tuple[Column, ...] = ()
    clauses: tuple[Column, ...] = ()
    factor: Column | None = None
    fields: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    start: int = 0
    rows: int | None = None

    def where(self, *predicates: Column) -> Search:
        """Only rows for which all predicates hold; they don't count for the score."""
        return replace(self, filters=self.filters + predicates)

    def query(self, *clauses: Column) -> Search:
        """Clauses of boosted(); rows that score 0 in all of them are left out."""
        return replace(self, clauses=self.clauses + clauses)

    def boost_by(self, name: str) -> Search:
        """Multiplies the score by a numeric field."""
        return replace(self, factor=F.col(name))

    def select(self, *names: str) -> Search:
        return replace(self, fields=self.fields + names)

    def sort(self, *columns: Column) -> Search:
        return replace(self, order=columns)

    def page(self, start: int, rows: int | None) -> Search:
        return replace(self, start=start, rows=rows)

    def matching(self) -> DataFrame:
        """All rows that match, scored, before sorting and paging."""
        df = reduce(DataFrame.where, self.filters, self.frame)
        if self.clauses:
            df = df.withColumn("score", reduce(Column.__add__, self.clauses)).where("score > 0")
            if self.factor is not None:
                df = df.withColumn("score", F.col("score") * self.factor)
        return df

    def facet(self, by: str, **aggregates: Column) -> DataFrame:
        """Named aggregates of each value of a field, over all matching rows."""
        return self.matching().groupBy(by).agg(*[c.alias(n) for n, c in aggregates.items()])

    def run(self) -> DataFrame:
        df = self.matching()
        if self.order:
            df = df.orderBy(*self.order)
        if self.start:
            df = df.offset(self.start)
        if self.rows is not None:
            df = df.limit(self.rows)
        return df.select(*dict.fromkeys(self.fields)) if self.fields else df

    def response(self) -> Response:
        return Response(self.run(), self.matching(), self.start)


@dataclass(frozen=True)
class Response:
    """One page of results; num_found counts all matching rows when asked."""

    page: DataFrame
    everything: DataFrame = field(repr=False)
    start: int = 0

    @property
    def num_found(self) -> int:
        return self.everything.count()
