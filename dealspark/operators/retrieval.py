"""What a question's answer is written from: facts of every company, dossiers of those it names, and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import normalize
from .finance import latest


def shown(c, blank: str = "-") -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(blank))


def deal_facts(notes: DataFrame) -> DataFrame:
    """(company_name, fact): one line per company from the note that came last."""
    last = latest(notes.where("trim(company_name) <> ''"), ["company_name"], F.col("ingested_at").desc_nulls_last(), F.col("id").desc())
    line = F.concat(F.lit("- "), "company_name", F.lit(" · "), shown("sector", "?"), F.lit(" · "), shown("stage", "?"), F.lit(" · ask "), shown("ask"), F.lit(" · rev "), shown("revenue"), F.lit(" · val "), shown("valuation"))
    return last.select("company_name", line.alias("fact"))


def named_companies(questions: DataFrame, names: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """(doc_id, company_name, n): the first `most` companies by name that each question (doc_id, text) names."""
    hits = normalize.mentions(questions, names.select(F.col("company_name").alias("id"), F.col("company_name").alias("canonical")), least)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    return hits.withColumn("n", n).where(F.col("n") <= most).select("doc_id", F.col("id").alias("company_name"), "n")


def dossier(questions: DataFrame, notes: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, dossier): a section for each of at most four companies that the question names."""
    facts = deal_facts(notes)
    part = F.concat(F.lit("## "), "company_name", F.lit("\n"), F.expr("substring(fact, 3)"))
    each = named_companies(questions, facts.select("company_name"), most=most).join(facts.hint("merge"), "company_name")
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("dossier"))


def excerpts(hits: DataFrame, cut: int = 700) -> DataFrame:
    """(doc_id, excerpts): the hits of a question (doc_id, rank, label, text), best first, each cut at 700 characters."""
    one = F.concat(F.lit("["), "label", F.lit("]\n"), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, cut))
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("excerpts"))


def context(questions: DataFrame, notes: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with their dossier and excerpts; the facts of all companies, the same for every question, stay a table."""
    out = questions.select("doc_id").join(dossier(questions, notes).hint("merge"), "doc_id", "left").join(excerpts(hits).hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("dossier", F.lit("(the question names no known company)")).alias("dossier"), F.coalesce("excerpts", F.lit("(no matching excerpts)")).alias("excerpts"))
