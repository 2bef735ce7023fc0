"""Model quality: accuracies, confusion, agreement, fitness, trial reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_mean(rows: DataFrame, most: int = 7) -> DataFrame:
    """accuracy of all rows, and the mean of the buckets' accuracies."""
    hit = (F.col("y") == F.col("yhat")).cast("int")
    by = rows.groupBy(F.least("syllables", F.lit(most)).alias("bucket")).agg(F.sum(hit).alias("right"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.round(F.sum("right") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("right") / F.col("n")), 4).alias("mean_of_buckets"))


def auc(rows: DataFrame, keys: list[str] = (), score: str = "score") -> DataFrame:
    """keys, auc: the chance that a row of label 1 scores above one of label 0,
    ties half; null where a label is missing.  rows: keys, y (0 or 1), score.

    Rows are counted by score first.  Running sums have two levels, over a
    thousand ranges of scores from 0 to 1 and inside one, so that no
    task holds all distinct scores.
    """
    keys = list(keys)
    cells = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_n"))
    cells = cells.withColumn("_range", F.floor(F.col("_s") * 1024))
    ranges = cells.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    by = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_sum").over(by), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_less", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ranges, [*keys, "_range"])
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_less") + F.col("_n") / 2.0))
    return cells.groupBy(*keys).agg(F.round(F.try_divide(wins, F.sum("_p").cast("double") * F.sum("_n")), 6).alias("auc"))


def ovr_auc(rows: DataFrame, n_classes: int) -> DataFrame:
    """auc: the mean over classes of each against the rest; 0 unless all classes
    have rows.  rows: y, p (array of a probability for each class)."""
    long = rows.select("y", F.posexplode("p").alias("label", "score")).select("label", "score", (F.col("y") == F.col("label")).cast("int").alias("y"))
    by = auc(long, ["label"])
    return by.agg(F.when(F.count("auc") == n_classes, F.round(F.avg("auc"), 6)).otherwise(0.0).alias("auc"))


def log_loss(rows: DataFrame, least: float = 1e-15) -> DataFrame:
    """log_loss.  rows: y, p (array of a probability for each class)."""
    own = F.get("p", F.col("y"))
    return rows.agg(F.round(-F.avg(F.log(F.greatest(F.lit(least), F.least(F.lit(1 - least), own)))), 6).alias("log_loss"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """precision, recall, f1 of label 1.  rows: y, yhat."""
    one = label_metrics(rows).where("label = 1")
    return one.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def accuracy_by_bucket(rows: DataFrame, most: int = 7) -> DataFrame:
    """bucket (null: all rows), n, accuracy in percent.  rows: syllables, y, yhat."""
    rows = rows.select(F.least("syllables", F.lit(most)).alias("bucket"), (F.col("y") == F.col("yhat")).cast("int").alias("hit"))
    return rows.rollup("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.sum("hit") / F.count(F.lit(1)), 4).alias("accuracy"))


def hand_accuracy(rows: DataFrame) -> DataFrame:
    """scored, right, accuracy.  rows: expected (array, null: not scored), yhat."""
    scored = rows.where(F.col("expected").isNotNull())
    right = F.count_if(F.array_contains("expected", F.col("yhat")))
    return scored.agg(F.count(F.lit(1)).alias("scored"), right.alias("right"), F.round(F.try_divide(100.0 * right, F.count(F.lit(1))), 4).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def label_metrics(rows: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of every label in y or yhat; 0 on
    division by zero."""
    cells = confusion(rows)
    labels = cells.select(F.col("y").alias("label")).union(cells.select("yhat")).distinct()
    by_y = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    by_p = cells.groupBy(F.col("yhat").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = labels.join(by_y, "label", "left").join(by_p, "label", "left").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * F.lit(1.0), F.col(b)), F.lit(0.0))
    rows = rows.withColumn("precision", share("tp", "predicted")).withColumn("recall", share("tp", "support"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return rows.select("label", "support", "precision", "recall", f1.alias("f1"))


def summary_metrics(rows: DataFrame) -> DataFrame:
    """accuracy, macro_f1, weighted_f1."""
    m = label_metrics(rows)
    right = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return m.agg(F.round(right, 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def agreement(rows: DataFrame) -> DataFrame:
    """both_right, both_wrong, only_a, only_b, verdict.  rows: y, a, b."""
    a, b = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    counts = rows.agg(F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    gap = (F.col("only_a") - F.col("only_b")) / (F.col("both_right") + F.col("both_wrong") + F.col("only_a") + F.col("only_b"))
    return counts.withColumn("verdict", F.when(F.abs(gap) < 0.001, "draw").when(gap > 0, "a").otherwise("b"))


#: Weights of the fitness presets.
PRESETS = {
    "specialist": {"f1": 0.45, "accuracy": 0.30, "hand": 0.25},
    "balanced": {"f1": 0.45, "accuracy": 0.20, "hand": 0.35},
    "global": {"f1": 0.30, "external": 0.25, "hand": 0.20, "syllables": 0.25},
}


def fitness(preset: str, parts: dict[str, Column], size_mb: Column, guard: Column | None = None, external: Column | None = None) -> Column:
    """Weighted parts, a little for small models, half if the accuracy on other
    words is below the accuracy that guards it."""
    total = sum((F.lit(w) * parts[k] for k, w in PRESETS[preset].items()), F.lit(0.0))
    total = total + 0.02 * (1 - F.least(F.lit(1.0), size_mb / 50.0))
    if guard is not None and external is not None:
        total = F.when((guard > 0) & (external < guard), total * 0.5).otherwise(total)
    return F.round(total, 6)


def leaderboard(trials: DataFrame, n: int = 30) -> DataFrame:
    """rank and the n best trials; earlier trials first among equals."""
    rank = F.row_number().over(Window.orderBy(F.desc("fitness"), "trial"))
    best = trials.orderBy(F.desc("fitness"), "trial").limit(n)
    return best.withColumn("rank", rank)


def phase_stats(trials: DataFrame) -> DataFrame:
    return trials.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("fitness").alias("best"),
        F.round(F.avg("fitness"), 6).alias("mean"),
        F.min("fitness").alias("worst"),
        F.round(F.stddev_pop("fitness"), 6).alias("std"),
        F.round(F.sum("minutes"), 4).alias("minutes"),
        F.round(100.0 * F.count_if("pruned") / F.count(F.lit(1)), 4).alias("pruned_percent"),
    )


def plateau(trials: DataFrame, keys: list[str], width: int = 10, flat: float = 0.002) -> DataFrame:
    """Per trial: range of the last ``width`` fitness values, whether they are
    flat, and trials since the last improvement over the trial before."""
    by = Window.partitionBy(*keys).orderBy("trial")
    last = by.rowsBetween(1 - width, 0)
    number = F.row_number().over(by)
    rows = trials.withColumn("_n", number).withColumn("_gain", F.col("fitness") - F.lag("fitness").over(by))
    rows = rows.withColumn("_up", F.max(F.when(F.col("_gain") > flat, F.col("_n"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.max("fitness").over(last) - F.min("fitness").over(last)
    full = F.count(F.lit(1)).over(last) == width
    return rows.select(*keys, "trial", F.round(span, 6).alias("span"), (full & (span < flat)).cast("int").alias("is_flat"), (F.col("_n") - F.coalesce("_up", F.lit(1))).cast("int").alias("since_gain"))


def parameter_insight(trials: DataFrame, parameters: list[str], n: int = 10) -> DataFrame:
    """parameter, mean among the n best and the n worst trials, direction;
    nothing while there are fewer than 2 n trials."""
    trials = trials.where(trials.select(F.count(F.lit(1))).scalar() >= 2 * n)
    best = trials.orderBy(F.desc("fitness"), "trial").limit(n).withColumn("_top", F.lit(True))
    worst = trials.orderBy("fitness", "trial").limit(n).withColumn("_top", F.lit(False))
    long = best.unionByName(worst).unpivot(["_top"], parameters, "parameter", "value")
    means = long.groupBy("parameter").agg(F.round(F.avg(F.when(F.col("_top"), F.col("value"))), 6).alias("top"), F.round(F.avg(F.when(~F.col("_top"), F.col("value"))), 6).alias("bottom"))
    return means.withColumn("direction", F.when(F.col("top") > F.col("bottom"), "higher").when(F.col("top") < F.col("bottom"), "lower").otherwise("none"))


def progression(trials: DataFrame) -> DataFrame:
    """Mean fitness of the first and the last third (at least one trial), equal
    trials in the order of their fitness.

    Trials are counted by ranges first, so that only the ranges in which a third
    ends are put in order."""
    rows = trials.select("trial", "fitness")
    n, least, most = rows.agg(F.count(F.lit(1)), F.min("trial"), F.max("trial")).first()
    third = max(1, n // 3)
    if least is None:
        return rows.agg(F.avg("fitness").alias("early"), F.avg("fitness").alias("late"))
    rows = rows.withColumn("_range", F.coalesce(F.floor((F.col("trial") - F.lit(least)) / F.lit(max(1, (most - least + 1) // 1024))), F.lit(-1)))
    parts = []
    for name, sign in (("early", 1), ("late", -1)):
        # ranges count up from the end that is asked for; there are about a thousand
        order, by = Window.orderBy(F.col("_range") * sign), F.col("_range")
        known = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("fitness").alias("_sum"), F.count("fitness").alias("_known"))
        known = known.withColumn("_to", F.sum("_n").over(order)).withColumn("_due", F.lit(third) - F.col("_to") + F.col("_n"))
        whole = known.where("_due >= _n").select("_sum", "_known")
        cut = known.where("_due > 0 AND _due < _n").select(by, "_due")
        trial = F.col("trial").asc() if sign > 0 else F.col("trial").desc()
        inside = rows.join(F.broadcast(cut), "_range").withColumn("_at", F.row_number().over(Window.orderBy(trial, "fitness"))).where("_at <= _due")
        part = whole.unionByName(inside.select(F.col("fitness").alias("_sum"), F.col("fitness").isNotNull().cast("long").alias("_known")))
        parts.append(part.agg(F.round(F.try_divide(F.sum("_sum"), F.sum("_known")), 6).alias(name)))
    return parts[0].crossJoin(parts[1])


def training_report(trials: DataFrame, parameters: list[str], n: int = 10) -> DataFrame:
    """section, name, value (text): phases, insights, landscape, progression
    and what they advise, as one long table."""
    line = lambda section, name, value: [F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value")]
    phases = phase_stats(trials)
    parts = [phases.select(*line("best of phase", F.col("phase"), F.format_string("%.6f", "best"))), phases.select(*line("trials of phase", F.col("phase"), F.col("n")))]
    insight = parameter_insight(trials, parameters, n)
    parts.append(insight.select(*line("direction", F.col("parameter"), F.col("direction"))))
    parts.append(landscape(trials, parameters, n).select(*line("range", F.col("parameter"), F.format_string("%.4f to %.4f", "least", "most"))))
    gain = progression(trials).select((F.col("late") - F.col("early")).alias("g"))
    parts.append(gain.select(*line("advice", F.lit("search"), F.when(F.col("g") > 0.002, "go on").when(F.col("g") < -0.002, "go back").otherwise("stop or widen"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaderboard_text(trials: DataFrame, n: int = 30) -> DataFrame:
    """rank, line: the leaderboard as lines of text with a bar."""
    bar = F.concat(F.repeat(F.lit("#"), F.floor(F.col("fitness") * 20).cast("int")), F.repeat(F.lit("."), 20 - F.floor(F.col("fitness") * 20).cast("int")))
    return leaderboard(trials, n).select("rank", F.concat(F.lpad(F.col("rank").cast("string"), 3, " "), F.lit("  "), F.format_string("%.6f", "fitness"), F.lit("  "), bar, F.lit("  "), F.col("phase"), F.lit(" "), F.col("trial")).alias("line"))


def accepted(rows: DataFrame, gain: float = 0.001) -> DataFrame:
    """base, ensemble (accuracies), base_hand, ensemble_hand (right words of the
    hand-made test), accept: does the ensemble gain enough, or know more of the
    words?  rows: y, base, ensemble, is_hand."""
    right = lambda c: F.avg((F.col(c) == F.col("y")).cast("double"))
    words = lambda c: F.count_if(F.col("is_hand") & (F.col(c) == F.col("y")))
    found = rows.agg(right("base").alias("base"), right("ensemble").alias("ensemble"), words("base").alias("base_hand"), words("ensemble").alias("ensemble_hand"))
    accept = (F.col("ensemble") - F.col("base") >= gain) | (F.col("ensemble_hand") > F.col("base_hand"))
    return found.select(F.round("base", 6).alias("base"), F.round("ensemble", 6).alias("ensemble"), "base_hand", "ensemble_hand", accept.cast("int").alias("accept"))


def class_weights(rows: DataFrame) -> DataFrame:
    """label, n, weight: inverse square root of the frequency, mean 1."""
    counts = rows.groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    raw = F.sqrt(F.sum("n").over(Window.partitionBy()) / F.col("n"))
    counts = counts.withColumn("_r", raw)
    return counts.select("label", "n", F.round(F.col("_r") / F.avg("_r").over(Window.partitionBy()), 6).alias("weight"))


def soft_vote(members: DataFrame) -> DataFrame:
    """row_id, yhat: probabilities of several models averaged by the softmax of
    their fitness; the first largest wins, where nine digits are compared: sums
    in another order are equal.  members: row_id, fitness, p (array)."""
    top = F.max("fitness").over(Window.partitionBy("row_id"))
    rows = members.withColumn("_w", F.exp(F.col("fitness") - top)).select("row_id", "_w", F.posexplode("p").alias("label", "p"))
    votes = rows.groupBy("row_id", "label").agg(F.round(F.sum(F.col("_w") * F.col("p")), 9).alias("v"))
    return votes.groupBy("row_id").agg(F.max_by("label", F.struct("v", -F.col("label"))).alias("yhat"))


def landscape(trials: DataFrame, parameters: list[str], n: int = 10) -> DataFrame:
    """parameter, least, most, mean over the n best trials."""
    best = trials.orderBy(F.desc("fitness"), "trial").limit(n)
    long = best.unpivot([], parameters, "parameter", "value")
    return long.groupBy("parameter").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def class_distribution(rows: DataFrame) -> DataFrame:
    """label, n, share: the largest share is what the majority class scores."""
    counts = rows.groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))
