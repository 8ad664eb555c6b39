"""LETOR judgement files: a line is a relevance, qid:N and id:value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..schemas import FEATURES, KIND, LETOR_ID

INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)"
NUMBER = f"^(?:{_DECIMAL})$"
#: The start of a good line, and its pairs: what stands between white space.
_SPACE = r"\p{IsWhite_Space}"
_HEAD = rf"^{_SPACE}*([+-]?[0-9]+){_SPACE}+qid:([+-]?[0-9]+)(?!\P{{IsWhite_Space}})"
_PAIR = rf"(?<!\P{{IsWhite_Space}})([+-]?[0-9]+):({_DECIMAL})(?!\P{{IsWhite_Space}})"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """line: of the files at path, as they are."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


def reason(line: Column) -> Column:
    """Why a line cannot be read, null if it can. Every pair is checked, those of ids that aren't kept too."""
    tokens = tokenize(line)
    qid = F.split(F.try_element_at(tokens, F.lit(2)), ":", -1)
    pairs = F.transform(F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda t: F.split(t, ":", -1))
    return (
        F.when(F.size(tokens) < 2, "fewer than two fields")
        .when(~F.element_at(tokens, 1).rlike(INTEGER), "relevance")
        .when((F.size(qid) != 2) | (F.element_at(qid, 1) != "qid") | ~F.try_element_at(qid, F.lit(2)).rlike(INTEGER), "qid")
        .when(F.exists(pairs, lambda p: F.size(p) != 2), "feature without one colon")
        .when(F.exists(pairs, lambda p: ~F.element_at(p, 1).rlike(INTEGER)), "feature id")
        .when(F.exists(pairs, lambda p: ~F.element_at(p, 2).rlike(NUMBER)), "feature value")
    )


def parse(lines: DataFrame, strict: bool = True, line: str = "line") -> DataFrame:
    """relevance, qid and the features of each line, with the other columns. Of an id that repeats the last value counts,
    absent ones are 0, whole-number features lose their fraction. Strict: a bad line fails the job; else it is left out
    (bad_lines() has those).

    A line is good if it starts as it must and all its other tokens are pairs. It is taken apart once: the generator keeps
    the optimizer from copying the expressions into whatever uses their results.
    """
    others = [c for c in lines.columns if c != line]
    text = F.col(line)
    pairs = lambda group: F.reverse(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(group)))
    tokens = F.regexp_count(text, F.lit(r"\P{IsWhite_Space}+"))
    good = F.coalesce((F.regexp_extract(text, _HEAD, 2) != "") & (tokens == F.size(pairs(1)) + 2), F.lit(False))
    taken = F.struct(F.regexp_extract(text, _HEAD, 1).alias("relevance"), F.regexp_extract(text, _HEAD, 2).alias("qid"), good.alias("good"), pairs(1).try_cast("array<int>").alias("ids"), pairs(2).try_cast("array<double>").alias("values"))
    apart = lines.select(*others, *([line] if strict else []), F.inline(F.array(taken)).alias("_relevance", "_qid", "_good", "_ids", "_values"))
    if strict:
        apart = apart.where(F.when(F.col("_good"), True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.coalesce(F.substring(line, 1, 200), F.lit("null")))).cast("boolean")))
    else:
        apart = apart.where("_good")
    # The lists are reversed, so the first place of an id is its last in the line. One list of all features keeps the
    # generated code small enough to be compiled.
    found = F.transform(F.array(*[F.lit(LETOR_ID[n]) for n in FEATURES]), lambda x: F.coalesce(F.get("_values", F.array_position("_ids", x).cast("int") - 1), F.lit(0.0)))
    read = apart.select(*others, F.col("_relevance").cast("int").alias("relevance"), F.col("_qid").cast("long").alias("qid"), found.alias("_f"))
    return read.select(*others, "relevance", "qid", *[(F.col("_f")[k].cast("int") if KIND[n] == "int" else F.col("_f")[k]).alias(n) for k, n in enumerate(FEATURES)])


def bad_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that cannot be read, with the reason."""
    return lines.withColumn("reason", reason(F.col(line))).where("reason is not null")
