"""Which kind of document a text is, by its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions import words as W
from pagewatch.functions.text import squeeze


def detect_kind(docs: DataFrame, text: str = "text", least: int = 4, margin: int = 2) -> DataFrame:
    """docs with kind, score, runner_up, runner_up_score, matched and reason.

    A kind is named only with a score of at least `least` and a lead of at least `margin`; ties go by name. The signals are a
    fixed list, so that the vote of a row is made of built-in expressions over the row alone: no join and no shuffle.
    """
    hay = F.lower(squeeze(F.coalesce(F.col(text), F.lit(""))))
    votes = []
    for kind, own in W.KIND_SIGNALS.items():
        found = F.array_compact(F.array(*(F.when(F.col("_hay").contains(p), F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for p, w in own)))
        votes.append(F.struct(F.lit(kind).alias("kind"), found.alias("found")))
    scored = F.transform(F.array(*votes), lambda v: F.struct((-F.aggregate(v["found"], F.lit(0), lambda s, x: s + x["weight"])).alias("low"), v["kind"].alias("kind"), v["found"]["phrase"].alias("matched")))
    ranked = F.array_sort(F.filter(scored, lambda v: v["low"] < 0))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    score, second_score = F.coalesce(-best["low"], F.lit(0)), F.coalesce(-second["low"], F.lit(0))
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 40
    reason = F.when(short, "no text").when(best.isNull(), "no words").when(score < least, "too weak").when(score - second_score < margin, "too close").otherwise("named")
    out = docs.withColumn("_hay", hay).withColumn("_ranked", ranked).withColumn("reason", reason)
    return out.withColumns(
        {
            "kind": F.when(F.col("reason") == "named", best["kind"]),
            "score": F.when(short, 0).otherwise(score),
            "runner_up": F.when(~short, second["kind"]),
            "runner_up_score": F.when(short, 0).otherwise(second_score),
            "matched": F.when(~short, best["matched"]),
        }
    ).drop("_hay", "_ranked")
