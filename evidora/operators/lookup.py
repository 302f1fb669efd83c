"""Literal look-up of table rows by the words, codes and numbers of a question, through an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions.text import fold, rare_terms

CODE, NAME = 100, 40


def structured_lookup(questions: DataFrame, rows: DataFrame, per_file: int = 3, at_most: int = 8, share: float = 0.05) -> DataFrame:
    """(query_id, id, score, position): the best rows of each question.

    rows (id, source_file, cells, code, name).  A shared term gives one point, the row's code in the question CODE, its whole
    name NAME.  Terms of more than a share of all rows (100 at least) select no row.  The best `per_file` of a file and `at_most`
    in all are kept: the feature.
    """
    total = rows.count()
    asked = questions.select("query_id", F.explode(rare_terms(F.col("question"))).alias("term"))
    terms = rows.select("id", "source_file", F.explode(rare_terms(F.array_join("cells", " "))).alias("term"))
    wanted = terms.join(asked.select("term").distinct(), "term", "left_semi")
    usable = wanted.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= max(100, int(share * total)))
    met = wanted.join(usable.select("term"), "term").join(asked, "term").groupBy("query_id", "id", "source_file").agg(F.count("*").alias("terms"))
    detail = met.join(rows.select("id", "code", "name"), "id").join(questions, "query_id")
    code = F.when(F.coalesce(F.contains("question", F.col("code")) & (F.length("code") >= 4), F.lit(False)), CODE).otherwise(0)
    name = F.when(F.coalesce(F.contains(fold(F.col("question")), fold(F.col("name"))) & (F.length("name") >= 4), F.lit(False)), NAME).otherwise(0)
    scored = detail.select("query_id", "id", "source_file", (F.col("terms") + code + name).alias("score"))
    w = Window.partitionBy("query_id", "source_file").orderBy(F.desc("score"), "id")
    kept = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= at_most).select("query_id", "id", "score", "position")
