"""Response quality metrics, each a one-row report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.overlap import lcs_sizes, ngram_overlap, tokens_13a, words_az09
from hearth.functions.safety import max_score
from hearth.operators.nearest import greedy_match

MAX_ORDER = 4


def pair_on_id(predictions: DataFrame, references: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions beside references by row id, never by physical order."""
    return predictions.join(references, row_id)


def bleu(pairs: DataFrame, pred: str = "pred", ref: str = "ref", fallback: str | None = None) -> DataFrame:
    """Corpus BLEU with 13a tokens, four orders and exponential smoothing.

    Both texts of a pair stand in one row, so its n-grams are counted and clipped
    there; a row needs no key, and only sums leave a task.
    """
    flag = F.col(fallback).cast("boolean") if fallback else F.lit(False)
    sides = [tokens_13a(F.coalesce(side, F.lit(""))) for side in (pred, ref)]
    counted = pairs.select(ngram_overlap(*sides, MAX_ORDER).alias("counts"), flag.alias("used"))
    orders = range(1, MAX_ORDER + 1)
    names = [*(f"match_{n}" for n in orders), *(f"total_{n}" for n in orders), "ref_len"]
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.get("counts", F.lit(i))), zero).alias(name) for i, name in enumerate(names)]
    totals = counted.agg(*sums, F.count("*").alias("samples"), F.count_if("used").alias("fallback_responses"))
    return totals.select(F.lit("bleu").alias("metric"), *bleu_score(), "samples", "fallback_responses")


def bleu_score() -> list[Column]:
    """Score columns from ``match_n, total_n, ref_len`` sums."""
    sys_len, ref_len = F.col("total_1"), F.col("ref_len")
    penalty = (
        F.when(sys_len >= ref_len, F.lit(1.0))
        .when(sys_len > 0, F.exp(1 - ref_len / sys_len))
        .otherwise(F.lit(0.0))
    )
    logs = []
    zeros = F.lit(0)
    for n in range(1, MAX_ORDER + 1):
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when((match == 0) & (total > 0), 1).otherwise(0)
        share = F.when(match > 0, match / total).otherwise(1.0 / (F.pow(F.lit(2.0), zeros) * total))
        logs.append(F.when(total > 0, F.log(share)))
    matched = sum((F.col(f"match_{n}") for n in range(2, MAX_ORDER + 1)), F.col("match_1"))
    mean_log = sum(logs[1:], logs[0]) / MAX_ORDER
    # a null logarithm (no n-gram of some order) makes the score 0
    score = F.when(matched > 0, 100 * penalty * F.exp(mean_log))
    return [
        F.coalesce(score, F.lit(0.0)).alias("bleu"),
        penalty.alias("brevity_penalty"),
        sys_len.cast("double").alias("sys_len"),
        ref_len.cast("double").alias("ref_len"),
    ]


def rouge_l_rows(pairs: DataFrame, pred: str = "pred", ref: str = "ref", stem: bool = True) -> DataFrame:
    """Add ``precision, recall, f1`` of the longest common subsequence of each pair."""
    sides = [words_az09(F.coalesce(side, F.lit(""))) for side in (pred, ref)]
    sized = pairs.withColumn("_l", lcs_sizes(*sides, stem))
    lcs, n_pred, n_ref = (F.get("_l", F.lit(i)) for i in range(3))
    precision = F.when(n_pred > 0, lcs / n_pred).otherwise(F.lit(0.0))
    recall = F.when(n_ref > 0, lcs / n_ref).otherwise(F.lit(0.0))
    scored = sized.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return scored.withColumn("f1", f1).drop("_l")


def rouge_l(pairs: DataFrame, pred: str = "pred", ref: str = "ref", stem: bool = True, fallback: str | None = None) -> DataFrame:
    flag = F.col(fallback).cast("boolean") if fallback else F.lit(False)
    scored = rouge_l_rows(pairs.select(pred, ref, flag.alias("used")), pred, ref, stem)
    return scored.agg(
        F.avg("f1").alias("rougeL_f1"),
        F.avg("precision").alias("rougeL_precision"),
        F.avg("recall").alias("rougeL_recall"),
        F.count("*").alias("samples"),
        F.count_if("used").alias("fallback_responses"),
    ).select(F.lit("rougeL").alias("metric"), "*")


def greedy_match_score(tokens: DataFrame, model_type: str = "hashed", row_id: str = "row_id", fallback: str | None = None, **names) -> DataFrame:
    """Means over all rows; ``fallback`` is a column of the tokens that marks rows answered by the fallback reply."""
    scored = greedy_match(tokens, row_id, **names)
    if fallback:
        marked = tokens.filter(F.col(fallback)).select(F.col(row_id), F.lit(True).alias("used")).distinct()
        scored = scored.join(marked, row_id, "left")
    else:
        scored = scored.withColumn("used", F.lit(False))
    return scored.agg(
        F.avg("precision").alias("bertscore_precision"),
        F.avg("recall").alias("bertscore_recall"),
        F.avg("f1").alias("bertscore_f1"),
        F.count("*").alias("samples"),
        F.count_if("used").alias("fallback_responses"),
    ).select(F.lit("bertscore").alias("metric"), "*", F.lit(model_type).alias("model_type"))


def emotion_alignment(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over gold and predicted labels together.

    The only shuffle of rows is a count per label pair; the rest works on label counts.
    """
    confusion = pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("in_gold"), F.lit(0).cast("long").alias("in_pred")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("in_gold"), F.col("n").alias("in_pred")),
    )
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    # a hit is counted on the gold side only
    per_label = (
        confusion.select(hit.alias("hit"), F.posexplode(sides).alias("side", "s"))
        .groupBy("s.label")
        .agg(
            F.sum("s.in_gold").alias("in_gold"),
            F.sum("s.in_pred").alias("in_pred"),
            F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("tp"),
        )
    )
    precision = F.coalesce(F.try_divide("tp", "in_pred"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "in_gold"), F.lit(0.0))
    scored = per_label.select("tp", "in_gold", precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    return scored.agg(
        (F.sum("tp") / F.sum("in_gold")).alias("accuracy"),
        F.avg("p").alias("precision_macro"),
        F.avg("r").alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
        F.coalesce(F.sum("in_gold"), F.lit(0)).alias("samples"),
    ).select(F.lit("emotion_alignment").alias("metric"), "*")


def toxicity_reduction(
    scored: DataFrame,
    scores: str = "scores",
    use_filter: bool = True,
    filter_threshold: float = C.TOXIC_THRESHOLD,
    count_threshold: float = C.TOXIC_THRESHOLD,
    refusal_score: float = 0.0,
    fallback: str | None = None,
) -> DataFrame:
    """Highest toxicity score per reply before and after the filter, averaged.

    Scores of the refusal are a parameter, since its text is fixed. A reply
    without scores is never toxic, whatever the threshold.
    """
    has_scores = F.coalesce(F.size(scores), F.lit(0)) > 0
    flag = F.col(fallback).cast("boolean") if fallback else F.lit(False)
    rows = scored.select(max_score(scores).alias("raw"), has_scores.alias("known"), flag.alias("used"))
    refused = F.col("known") & (F.col("raw") >= filter_threshold) & F.lit(use_filter)
    rows = rows.withColumn("post", F.when(refused, F.lit(float(refusal_score))).otherwise(F.col("raw")))
    totals = rows.agg(
        F.avg("raw").alias("avg_toxicity_raw"),
        F.avg("post").alias("avg_toxicity_post"),
        F.count("*").alias("samples"),
        F.count_if(F.col("known") & (F.col("raw") >= count_threshold)).alias("toxic_raw_count"),
        F.count_if(F.col("known") & (F.col("post") >= count_threshold)).alias("toxic_post_count"),
        F.count_if("used").alias("fallback_responses"),
    )
    drop = F.col("avg_toxicity_raw") - F.col("avg_toxicity_post")
    percent = F.when(F.col("avg_toxicity_raw") > 0, drop / F.col("avg_toxicity_raw") * 100).otherwise(F.lit(0.0))
    return totals.select(
        F.lit("toxicity").alias("metric"),
        "avg_toxicity_raw",
        "avg_toxicity_post",
        drop.alias("absolute_reduction"),
        percent.alias("percent_reduction"),
        "samples",
        "toxic_raw_count",
        "toxic_post_count",
        "fallback_responses",
        F.lit(use_filter).alias("filter_applied"),
    )
