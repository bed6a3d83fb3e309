"""Rater agreement, thresholds and questionnaire statistics. Undefined values are null with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.guards import require
from corpuslens.operators.running import running

Z95 = 1.959963984540054


def cohen(ratings: DataFrame, categories: int, weights: str = "none") -> DataFrame:
    """n, observed and expected disagreement, kappa of two raters' ordinals (a, b) in 0..categories-1."""
    n = ratings.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))

    def weight(a: Column, b: Column) -> Column:
        far = F.abs(a - b).cast("double") / (categories - 1)
        return {"none": (a != b).cast("double"), "linear": far, "quadratic": far * far}[weights]

    total = n.agg(F.sum("n").alias("total"))
    observed = n.agg(F.sum(weight(F.col("a"), F.col("b")) * F.col("n")).alias("o"))
    rows, cols = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = rows.crossJoin(cols).agg(F.sum(weight(F.col("a"), F.col("b")) * F.col("na") * F.col("nb")).alias("e"))
    got = total.crossJoin(observed).crossJoin(expected).select(F.col("total").alias("n"), (F.col("o") / F.col("total")).alias("observed"), (F.col("e") / (F.col("total") * F.col("total"))).alias("expected"))
    return got.withColumn("kappa", 1 - F.try_divide("observed", "expected")).withColumn("undefined_reason", F.when(F.col("expected") == 0, "chance_agreement_is_one"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """kappa of several raters (item, rater, category), the same number for each item."""
    per = ratings.groupBy("item", "category").agg(F.count("*").alias("n"))
    item = per.groupBy("item").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.sum("n").alias("m"))
    p = item.agg(F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1)).cast("double")).alias("p"), F.count("*").alias("items"))
    share = per.groupBy("category").agg(F.sum("n").alias("n")).withColumn("q", F.col("n") / F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    chance = share.agg(F.sum(F.col("q") * F.col("q")).alias("pe"))
    return p.crossJoin(chance).select("items", "p", "pe", F.try_divide(F.col("p") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def final_level(levels: Sequence[Column], scale: Sequence[str]) -> Column:
    """The median of three labels by the order of the scale: the majority, or the middle."""
    place = F.array(*(F.array_position(F.array(*(F.lit(s) for s in scale)), c) for c in levels))
    return F.element_at(F.array(*(F.lit(s) for s in scale)), F.element_at(F.array_sort(place), 2).cast("int"))


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A point at each distinct score (of each group): tau, tp, fp, fn, tn, precision, recall, f1 of predicting 1 from tau up.

    Rows are counted per distinct score first, and the counts added up range by range.
    """
    step = scored.groupBy(*by, F.col("score").alias("tau")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    whole = step.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("total"))
    cum = running(step, "tau", {"tp": "pos", "predicted": "n"}, by, descending=True)
    cum = cum.join(F.broadcast(whole), list(by)) if by else cum.crossJoin(F.broadcast(whole))
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("positives") - F.col("tp")
    return cum.select(*by, "tau", tp, fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("positives") - fp).alias("tn"), *rates(tp, fp, fn))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, null where nothing is predicted, nothing is positive, neither."""
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    return [div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def best_point(curve: DataFrame, by: Sequence[str] = (), tie: str = "highest_tau") -> DataFrame:
    """The point with the greatest F1; among equals the highest or lowest tau. No positive: F1 is 0 everywhere and the tie decides."""
    order = F.col("tau") if tie == "highest_tau" else -F.col("tau")
    cols = [c for c in curve.columns if c not in by]
    best = F.max_by(F.struct(*cols), F.struct(F.round("f1", 12), order))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def confusion(scored: DataFrame, tau: Column, by: Sequence[str] = ()) -> DataFrame:
    yes, true = F.col("score") >= tau, F.col("label") == 1
    got = scored.groupBy(*by).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    return got.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def with_folds(scored: DataFrame, id_col: str, seed: str, k: int) -> DataFrame:
    """Stratified folds by a hash order within each label, the same for every score."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)
    return scored.withColumn("fold", ((F.row_number().over(W.partitionBy("label").orderBy(order, id_col)) - 1) % k).cast("long"))


def cross_validated(folded: DataFrame, k: int, tie: str = "highest_tau") -> tuple[DataFrame, DataFrame]:
    """The threshold learned without each fold with the fold's own counts; and the pooled held-out F1. One pass over all folds together."""
    train = folded.withColumn("left_out", F.explode(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), F.array("fold"))))
    taus = best_point(pr_curve(train, ["left_out"]), ["left_out"], tie).select(F.col("left_out").alias("fold"), "tau")
    held = confusion(folded.join(F.broadcast(taus), "fold"), F.col("tau"), ["fold", "tau"])
    pooled = held.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return held, pooled


def bootstrap(scored: DataFrame, id_col: str, taus: dict[str, float], resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """F1 of each score column at its threshold over the same Poisson(1) resamples: interval per score, and of the difference of two.

    A row's weight in a resample is drawn from a hash of seed, resample and id: the resamples are the same wherever the row is, need no shuffle
    of rows, and nothing but counts is kept of them.
    """
    # Cumulative Poisson(1) probabilities.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    drawn = scored.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col(id_col).cast("string")))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("u")
    weighted = drawn.select("*", u).withColumn("w", sum(((F.col("u") >= s).cast("int") for s in steps[1:]), (F.col("u") >= steps[0]).cast("int")))
    counts = []
    for name, tau in taus.items():
        yes, true = F.col(name) >= tau, F.col("label") == 1
        counts += [F.sum(F.when(yes & true, F.col("w")).otherwise(0)).alias(f"{name}_tp"), F.sum(F.when(yes != true, F.col("w")).otherwise(0)).alias(f"{name}_wrong")]
    f1 = weighted.groupBy("resample").agg(*counts).select("resample", *(F.try_divide((2 * F.col(f"{n}_tp")).cast("double"), 2 * F.col(f"{n}_tp") + F.col(f"{n}_wrong")).alias(n) for n in taus))
    names = list(taus)
    if len(names) == 2:
        f1 = f1.withColumn("difference", F.col(names[0]) - F.col(names[1]))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    stats = [F.struct(F.lit(c).alias("measure"), F.percentile(c, F.lit(low)).alias("low"), F.percentile(c, F.lit(high)).alias("high"), F.count_if(F.col(c).isNull()).alias("undefined")) for c in f1.columns[1:]]
    return f1.agg(F.array(*stats).alias("s")).select(F.inline("s")).withColumn("tie", F.when(F.col("measure") == "difference", (F.col("low") <= 0) & (F.col("high") >= 0)))


def likert(answers: DataFrame, reverse: Sequence[str], low: int, high: int) -> DataFrame:
    """Frequencies, median and quartiles of each item (respondent, item, value), with reverse-coded items turned round."""
    value = F.when(F.col("item").isin(list(reverse)), low + high - F.col("value")).otherwise(F.col("value"))
    rows = answers.withColumn("v", value)
    freq = [F.count_if(F.col("v") == x).alias(f"n{x}") for x in range(low, high + 1)]
    return rows.groupBy("item").agg(F.count("v").alias("n"), *freq, F.percentile("v", F.lit(0.25)).alias("q1"), F.median("v").alias("median"), F.percentile("v", F.lit(0.75)).alias("q3"))


def _alpha(n: Column, parts: Column, whole: Column, k: int) -> list[Column]:
    """alpha of k items and why it is undefined."""
    reason = F.when(F.lit(k < 2), "one_item").when(n < 2, "fewer_than_two_rows").when(whole == 0, "no_variance")
    alpha = F.lit(k / (k - 1) if k > 1 else 0.0) * (1 - F.try_divide(parts, whole))
    return [F.when(reason.isNull(), alpha).alias("alpha"), reason.alias("undefined_reason")]


def cronbach(wide: DataFrame, items: Sequence[str]) -> DataFrame:
    """alpha over rows that answer every item."""
    return cronbach_if_deleted(wide, items).filter("deleted is null").drop("deleted")


def cronbach_if_deleted(wide: DataFrame, items: Sequence[str]) -> DataFrame:
    """n and alpha over rows that answer every item: of all items (deleted is null), and of those left without each; one pass."""
    rows = wide.dropna(subset=list(items))
    total = lambda some: sum((F.col(i) for i in some[1:]), F.col(some[0])) if some else F.lit(0.0)
    sets = [(None, list(items)), *((i, [x for x in items if x != i]) for i in items)]
    stats = [F.count("*").alias("n"), *(F.var_samp(i).alias(f"v_{k}") for k, i in enumerate(items)), *(F.var_samp(total(some)).alias(f"w_{k}") for k, (_, some) in enumerate(sets))]
    got = rows.agg(*stats)
    part = lambda some: sum((F.col(f"v_{items.index(i)}") for i in some), F.lit(0.0))
    each = [F.struct(F.lit(name).cast("string").alias("deleted"), F.col("n"), *_alpha(F.col("n"), part(some), F.col(f"w_{k}"), len(some))) for k, (name, some) in enumerate(sets)]
    return got.select(F.inline(F.array(*each)))


def answer_matrix(answers: DataFrame, low: int, high: int) -> DataFrame:
    """Answers (respondent, item, value) that are whole numbers of the scale or null, one a respondent and item, with every respondent asked every
    item; other answers stop the job, with all faults at once."""
    if not low < high:
        raise ValueError("the scale has two ends")
    v = F.col("value").cast("double")
    checked = require(answers, {"answers are on the scale": F.col("value").isNull() | ((v == F.floor(v)) & v.between(low, high)), "items have a name": F.coalesce(F.trim("item") != "", F.lit(False))})
    shape = checked.agg(F.countDistinct("respondent").alias("r"), F.countDistinct("item").alias("i"), F.count("*").alias("n"), F.countDistinct("respondent", "item").alias("d")).first()
    if shape.n != shape.d or shape.n != shape.r * shape.i:
        raise ValueError(f"{shape.r} respondents and {shape.i} items make {shape.r * shape.i} answers, not {shape.n}")
    return checked


def dimensions(groups: dict[str, Sequence[str]], items: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The items of each dimension, if these part the items: each in exactly one, none empty, none unknown."""
    flat = [i for members in groups.values() for i in members]
    problems = [f"{d} has no item" for d, m in groups.items() if not m]
    problems += [f"{i} is in {flat.count(i)} dimensions" for i in sorted(set(flat) | set(items)) if flat.count(i) != 1]
    problems += [f"{i} has no answers" for i in sorted(set(flat) - set(items))]
    if problems:
        raise ValueError("; ".join(problems))
    return {d: tuple(m) for d, m in groups.items()}


def verification(judged: DataFrame, target: float) -> DataFrame:
    """Accuracy of judged rows (program, general, specific, status) overall and by program: judged, correct, partial, accuracy, its interval, accuracy
    with true absences, and for the specific ones those that apply and are correct. ``meets_target`` is the overall accuracy's."""
    one = lambda c: F.count_if(c)
    absent = (F.col("status") == "not_found") & (F.col("general") == "absent")
    got = judged.rollup("program").agg(
        F.grouping("program").alias("overall"),
        F.count("*").alias("judged"),
        one(F.col("general") == "correct").alias("correct"),
        one(F.col("general") == "partial").alias("partial"),
        one(absent).alias("true_absences"),
        one(F.col("specific") != "not_applicable").alias("applicable"),
        one(F.col("specific") == "correct").alias("specific_correct"),
    )
    share = F.col("correct") / F.col("judged")
    specific = F.try_divide(F.col("specific_correct").cast("double"), F.col("applicable"))
    return got.select(
        F.when(F.col("overall") == 1, "(all)").otherwise(F.col("program")).alias("program"), "judged", "correct", "partial", share.alias("accuracy"), *wilson(share, F.col("judged")),
        ((F.col("correct") + F.col("true_absences")) / F.col("judged")).alias("accuracy_with_absences"), "applicable", specific.alias("specific_accuracy"),
        F.when(F.col("overall") == 1, share >= target).alias("meets_target"),
    )


def aiken(ratings: DataFrame, low: int, high: int, z: float = Z95) -> DataFrame:
    """V of each item (item, rating), with its score interval."""
    per = ratings.groupBy("item").agg(F.count("rating").alias("n"), F.sum(F.col("rating") - low).alias("s"))
    v = F.try_divide(F.col("s").cast("double"), F.col("n") * (high - low))
    trials = F.col("n") * (high - low)
    return per.select("item", "n", v.alias("v"), *wilson(v, trials, z))


def wilson(p: Column, n: Column, z: float = Z95) -> list[Column]:
    """The score interval of a share p of n; exactly 0 and 1 at the ends."""
    middle, half = 2 * n * p + z * z, z * F.sqrt(z * z + 4 * n * p * (1 - p))
    below, above = (middle - half) / (2 * (n + z * z)), (middle + half) / (2 * (n + z * z))
    return [F.when(p == 0, 0.0).otherwise(below).alias("low"), F.when(p == 1, 1.0).otherwise(above).alias("high")]
