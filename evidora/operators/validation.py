"""Checks of answers against their sources: numbers, citations, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions.numbers import normalized
from evidora.functions.text import cited_pages, claims, fold

NUMBER = r"(?<![\w.,])[-−]?[0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?(?:\s*%)?(?![\w])"


def numbers_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, literal, value, percent) of every distinct number of each text."""
    found = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(NUMBER), F.lit(0)))).alias("literal"))
    return found.select("id", "literal", normalized(F.col("literal")).try_cast("decimal(38,6)").alias("value"), F.col("literal").endswith("%").alias("percent")).where("value is not null")


def validate_numbers(answers: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(answer_id, numbers, supported): how many numbers of an answer occur, with the same percent sign, in a source it cites.

    answers (answer_id, text), sources (source_id, text), links (answer_id, source_id).
    """
    asked = numbers_of(answers, "answer_id", "text").withColumnRenamed("id", "answer_id")
    known = numbers_of(sources, "source_id", "text").select(F.col("id").alias("source_id"), "value", "percent").distinct()
    there = links.join(known, "source_id").select("answer_id", "value", "percent", F.lit(True).alias("seen")).distinct()
    return asked.join(there, ["answer_id", "value", "percent"], "left").groupBy("answer_id").agg(F.count("*").alias("numbers"), F.count("seen").alias("supported"))


def validate_citations(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """(answer_id, source, page, known): every cited page and whether the collection has it.

    A citation without pages is known if its source has any page.  pages: (source, page).
    """
    cited = answers.select("answer_id", F.explode(cited_pages(F.col("text"))).alias("c")).select("answer_id", "c.source", F.explode_outer("c.pages").alias("page")).distinct()
    have = pages.select("source", "page").distinct()
    some = have.select("source").distinct().withColumn("any_page", F.lit(True))
    judged = cited.join(have.withColumn("this_page", F.lit(True)), ["source", "page"], "left").join(some, "source", "left")
    return judged.select("answer_id", "source", "page", F.coalesce(F.when(F.col("page").isNull(), F.col("any_page")).otherwise(F.col("this_page")), F.lit(False)).alias("known"))


def long_words(c: Column, least: int = 5) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


def claim_evidence(answers: DataFrame, sources: DataFrame, links: DataFrame, k: int = 3, shared: int = 2) -> DataFrame:
    """(answer_id, claim_no, source_id, words, position): the k sources of an answer that share most long words with a claim."""
    said = answers.select("answer_id", F.posexplode(claims(F.col("text"))).alias("claim_no", "claim"))
    words = said.select("answer_id", "claim_no", F.explode(long_words(F.col("claim"))).alias("word"))
    known = links.join(sources.select("source_id", F.explode(long_words(F.col("text"))).alias("word")), "source_id")
    met = words.join(known, ["answer_id", "word"]).groupBy("answer_id", "claim_no", "source_id").agg(F.count("*").alias("words")).where(F.col("words") >= shared)
    w = Window.partitionBy("answer_id", "claim_no").orderBy(F.desc("words"), "source_id")
    return met.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
