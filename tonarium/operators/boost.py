"""Gradient boosting in rounds, with early stop, and models as tables.

Each round grows one tree a class.  A tree grows level by level: tasks sum the
gradients of their rows by node, feature and bin, the sums of all tasks are
added as a tree, and the driver picks the best split of every node from that
one array, whose size the setting bounds (classes x nodes x features x bins).
The first pass of a round also sums the losses of the training and the held-out
rows, so that rounds stop where the held-out loss does.

A fitted model is a table of nodes.  walk() answers from it inside the row, as
an expression; walk_recursive() is the same as a recursive query.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.scratch import stored

NODES = "tree int, round int, class int, node int, feature int, name string, threshold double, `left` int, `right` int, leaf double"
METRICS = "round int, train_loss double, held_loss double, best boolean"


@dataclass(frozen=True)
class Setting:
    """rounds and depth at most; rate of a round; bins a feature; least sum of
    second derivatives of a leaf; l2 on leaf values; rounds without a better
    held-out loss before it stops; rounds after which scores are stored anew."""

    rounds: int = 100
    depth: int = 4
    rate: float = 0.1
    bins: int = 63
    least: float = 1.0
    l2: float = 1.0
    patience: int = 5
    refresh: int = 10


@dataclass
class Model:
    """names of the features, thresholds of their bins, prior score and trees;
    a tree is a round, a class and its nodes (feature or -1, bin, left, right,
    leaf value).  grown holds the trees of the rounds after the best, too."""

    names: list[str]
    edges: list[list[float]]
    prior: list[float]
    trees: list[tuple[int, int, list[list]]] = field(default_factory=list)
    metrics: list[tuple[int, float, float, bool]] = field(default_factory=list)
    grown: list[tuple[int, int, list[list]]] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """The rows of the table of nodes; tree -1 and down hold the prior."""
        out = [(-1 - k, -1, k, 0, -1, None, None, None, None, p) for k, p in enumerate(self.prior)]
        for tree, (round_, label, nodes) in enumerate(self.trees):
            for k, (f, b, left, right, leaf) in enumerate(nodes):
                out.append((tree, round_, label, k, f, *((self.names[f], self.edges[f][b - 1], left, right, None) if f >= 0 else (None, None, None, None, leaf))))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODES)

    def rounds(self, spark: SparkSession) -> DataFrame:
        """round, train_loss, held_loss, best: what each round reached."""
        return spark.createDataFrame(self.metrics, METRICS)


def bin_edges(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Each feature's thresholds: all its values but the greatest, or quantiles
    where there are more than bins of them."""
    counts = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if counts[c] <= 2 * bins]
    exact: dict[str, list] = {c: [] for c in names}
    if few:  # at most about two bins' worth of values each
        values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in few])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)").distinct()
        for r in values.collect():
            exact[r["c"]].append(r["v"])
    many = [c for c in names if c not in few or len(exact[c]) > bins + 1]
    cuts = dict(zip(many, rows.approxQuantile(many, [k / (bins + 1) for k in range(1, bins + 1)], 0.001), strict=True)) if many else {}
    return [sorted(set(cuts[c])) if c in cuts else sorted(exact[c])[:-1] for c in names]


def _binned(names: list[str], edges: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.uint8)
            for k, cuts in enumerate(edges):
                x = batch.column(k).to_numpy(zero_copy_only=False).astype(float)
                out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(cuts, x, "left") + 1)
            rows = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column(len(names)), batch.column(len(names) + 1), pa.nulls(batch.num_rows, pa.binary())], ["b", "y", "held", "scores"])

    return run


def _place(nodes: list[list], b: np.ndarray) -> np.ndarray:
    """The node that each row of bins ends in; what has no value goes left."""
    f, cut, left, right, _ = (np.array(x) for x in zip(*[(n[0], n[1] or 0, n[2] or 0, n[3] or 0, 0) for n in nodes], strict=True))
    at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    while (inner := f[at] >= 0).any():
        at = np.where(inner, np.where(b[rows, np.maximum(f[at], 0)] <= cut[at], left[at], right[at]), at)
    return at


def _scored(batch: pa.RecordBatch, prior: list[float], many: int, trees: dict[int, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins, labels, held-out flags and scores (row, model, class) of a batch;
    trees: those of each model that its stored scores lack."""
    n = batch.num_rows
    b = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(n, -1)
    stored_ = batch.column("scores").to_pylist()
    scores = np.tile(np.array(prior), (n, many, 1)) if n and stored_[0] is None else np.frombuffer(b"".join(stored_), np.float64).reshape(n, many, -1).copy()
    for m, of_model in trees.items():
        for _, label, nodes in of_model:
            scores[:, m, label] += np.array([x[4] or 0.0 for x in nodes])[_place(nodes, b)]
    return b, batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), scores


def _rescore(prior: list[float], many: int, trees: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scored(batch, prior, many, trees)[3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in scores], pa.binary())], ["b", "y", "held", "scores"])

    return run


def _sums(prior: list[float], many: int, trees: dict[int, list], growing: dict[int, list[list[list]]], open_: dict[int, list[list[int]]], bins: int, features: int):
    """One task, one array: for each model that grows, losses and row counts of
    training and held-out rows, then sums of first and second derivatives by
    class, open node, feature and bin."""
    classes, slots = len(prior), {m: max(map(len, o)) for m, o in open_.items()}  # the same slots for all classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(4) for m in growing}
        sums = {m: np.zeros((classes, 2, slots[m] * features * bins)) for m in growing}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins_, y_, held, scores = _scored(batch, prior, many, trees)
            b, y = bins_[~held], y_[~held]
            for m in growing:
                p = np.exp(scores[:, m] - scores[:, m].max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                loss = -np.log(np.maximum(p[np.arange(len(y_)), y_], 1e-15))
                total[m] += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
                p = p[~held]
                for k in range(classes):
                    slot = np.full(len(growing[m][k]), -1)
                    slot[np.array(open_[m][k], np.int64)] = np.arange(len(open_[m][k]))
                    slot = slot[_place(growing[m][k], b)]
                    here = np.flatnonzero(slot >= 0)
                    at = ((slot[here, None] * features + np.arange(features)) * bins + b[here]).ravel()
                    q = p[here, k]
                    for j, v in enumerate((q - (y[here] == k), q * (1 - q))):
                        sums[m][k, j] += np.bincount(at, np.repeat(v, features), sums[m].shape[2])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x for m in growing for x in (total[m], sums[m].ravel())]).tobytes()], pa.binary())], ["sums"])

    return run


def _best_split(g: np.ndarray, h: np.ndarray, setting: Setting) -> tuple | None:
    """(gain, feature, bin, sums of the left side) of a node's features x bins."""
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    gr, hr = all_g - gl, all_h - hl
    gain = gl**2 / (hl + setting.l2) + gr**2 / (hr + setting.l2) - all_g**2 / (all_h + setting.l2)
    gain = np.where((hl >= setting.least) & (hr >= max(setting.least, 1e-12)), np.round(gain, 9), -1.0)
    gain[:, 0] = -1.0  # what has no value stays with the least values
    at = int(gain.argmax())  # of equals the first feature, then the least bin
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b, float(gl[f, b]), float(hl[f, b])) if gain[f, b] > 1e-9 else None


def _grow(nodes: list[list], open_: list[int], sums: np.ndarray, setting: Setting) -> list[int]:
    """Split the open nodes of a tree where that gains; the new open nodes."""
    opened = []
    leaf = lambda g, h: -setting.rate * g / (h + setting.l2)
    for slot, at in enumerate(open_):
        g, h = sums[0, slot], sums[1, slot]
        all_g, all_h = float(g[0].sum()), float(h[0].sum())
        nodes[at][4] = leaf(all_g, all_h)
        if (found := _best_split(g, h, setting)) is not None:
            _, f, b, gl, hl = found
            nodes[at][:4] = [f, b, len(nodes), len(nodes) + 1]
            opened += [len(nodes), len(nodes) + 1]
            nodes += [[-1, None, None, None, leaf(gl, hl)], [-1, None, None, None, leaf(all_g - gl, all_h - hl)]]
    return opened


def fit(rows: DataFrame, names: list[str], *, label: str = "y", held: str = "held", classes: int | None = None, setting: Setting = Setting(), stop: Callable[[int, float], bool] | None = None) -> Model:  # noqa: B008
    """A model of the rows that are not held out (column held), stopped by the
    loss of those that are.

    label: a number from 0; stop(round, held-out loss) may end it earlier (a
    trial that is pruned).  Rows without a label go; missing features go left.
    Without rows to learn from it is a ValueError.
    """
    return fit_many(rows, names, [setting], label=label, held=held, classes=classes, stop=stop)[0]


def fit_many(rows: DataFrame, names: list[str], settings: list[Setting], *, label: str = "y", held: str = "held", classes: int | None = None, stop: Callable[[int, float], bool] | None = None) -> list[Model]:
    """The model that fit() returns of each setting; all grow in the same passes
    over the rows, until each has stopped.  The settings' bins are the same."""
    if len({s.bins for s in settings}) > 1:
        raise ValueError("settings with different bins")
    rows = rows.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("int").alias("_y"), F.coalesce(F.col(held).cast("boolean"), F.lit(False)).alias("_held"))
    counts = {r["_y"]: r["n"] for r in rows.where("NOT _held").groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to learn from")
    classes = classes or max(rows.agg(F.max("_y")).first()[0] + 1, 2)
    n, bins, many = sum(counts.values()), settings[0].bins, len(settings)
    prior = [math.log(max(counts.get(k, 0), 1e-6) / n) for k in range(classes)]
    edges = bin_edges(rows.where("NOT _held"), names, bins)
    models, best = [Model(list(names), edges, prior) for _ in settings], [(math.inf, 0)] * many
    width, refresh, live = bins + 2, min(s.refresh for s in settings), list(range(many))
    schema = "b binary, y int, held boolean, scores binary"
    data, done = stored(rows.mapInArrow(_binned(list(names), edges), schema), "binned"), 0
    for round_ in range(max(s.rounds for s in settings) + 1):
        growing: dict[int, list[list[list]]] = {m: [[[-1, None, None, None, 0.0]] for _ in range(classes)] for m in live}
        open_ = {m: [[0] for _ in range(classes)] for m in live}
        for level in range(max(settings[m].depth for m in live)):
            here = [m for m in live if level < settings[m].depth and any(open_[m])]
            if not here:
                break
            task = _sums(prior, many, {m: models[m].trees[done:] for m in here}, {m: growing[m] for m in here}, {m: open_[m] for m in here}, width, len(names))
            sums = data.mapInArrow(task, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"])).treeReduce(np.add)
            for m in here:
                shape = (classes, 2, max(map(len, open_[m])), len(names), width)
                own, sums = np.split(sums, [4 + math.prod(shape)])
                if level == 0:
                    train_loss, held_loss = (float(own[k] / own[k + 1]) if own[k + 1] else math.nan for k in (0, 2))
                    watched = train_loss if math.isnan(held_loss) else held_loss
                    models[m].metrics.append((round_, train_loss, held_loss, False))
                    best[m] = min(best[m], (watched, round_))
                    if round_ == settings[m].rounds or round_ - best[m][1] >= settings[m].patience or bool(stop and stop(round_, watched)):
                        live.remove(m)
                        continue
                by_node = own[4:].reshape(shape)
                open_[m] = [_grow(nodes, slots, by_node[k], settings[m]) for k, (nodes, slots) in enumerate(zip(growing[m], open_[m], strict=True))]
            if not live:
                break
        if not live:
            break
        for m in live:
            models[m].trees += [(round_, k, nodes) for k, nodes in enumerate(growing[m])]
        if (round_ + 1) * classes - done >= refresh * classes:
            data = stored(data.mapInArrow(_rescore(prior, many, {m: models[m].trees[done:] for m in live}), schema), "scores")
            done = (round_ + 1) * classes
    for model, (_, last) in zip(models, best, strict=True):
        model.grown, model.trees = model.trees, [t for t in model.trees if t[0] < last]
        model.metrics = [(r, a, b, r == last) for r, a, b, _ in model.metrics]
    return models


# --- answers from the table ----------------------------------------------------


def _literal(model: DataFrame) -> tuple[Column, int, int, list[tuple[int, str]]]:
    """The trees as one constant, number of classes, depth, and the features.
    A model has as many nodes as its setting allows, so it fits the driver."""
    by_tree: dict[int, dict] = {}
    names: dict[int, str] = {}
    for r in model.collect():
        by_tree.setdefault(r["tree"], {"c": r["class"], "nodes": {}})["nodes"][r["node"]] = {"f": r["feature"], "t": r["threshold"], "l": r["left"], "r": r["right"], "v": r["leaf"] or 0.0}
        if r["feature"] >= 0:
            names[r["feature"]] = r["name"]
    if not by_tree:
        raise ValueError("a model without nodes")

    def height(nodes: dict, at: int = 0) -> int:
        return 0 if nodes[at]["f"] < 0 else 1 + max(height(nodes, nodes[at]["l"]), height(nodes, nodes[at]["r"]))

    trees = [{"c": t["c"], "n": [t["nodes"][k] for k in sorted(t["nodes"])]} for _, t in sorted(by_tree.items())]
    kind = "array<struct<c: int, n: array<struct<f: int, t: double, l: int, r: int, v: double>>>>"
    return F.from_json(F.lit(json.dumps(trees)), kind), max(t["c"] for t in trees) + 1, max(height(t["nodes"]) for t in by_tree.values()), sorted(names.items())


def scores(model: DataFrame) -> Column:
    """The summed leaf values of each class, as an array: every tree is walked
    inside the row.  The row has the model's features as columns; a missing one
    goes left."""
    trees, classes, depth, names = _literal(model)
    values = {k: F.coalesce(F.when(F.isnan(F.col(n).cast("double")), None).otherwise(F.col(n).cast("double")), F.lit(float("-inf"))) for k, n in names}
    x = F.array(*[values.get(k, F.lit(0.0)) for k in range(max(values, default=0) + 1)])

    def end(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(nodes, at)
            return F.when(node["f"] < 0, at).when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])

        return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), F.lit(0), step)

    leaves = F.transform(trees, lambda t: F.struct(t["c"].alias("c"), F.get(t["n"], end(t["n"]))["v"].alias("v")))
    zero = F.array_repeat(F.lit(0.0), classes)
    return F.aggregate(leaves, zero, lambda s, t: F.transform(s, lambda v, c: F.when(c == t["c"], v + t["v"]).otherwise(v)))


def answer(scored: str | Column, syllables: Column | None = None) -> Column:
    """The class of the highest score, the first of equals; null beyond the
    word's syllables."""
    scored = F.col(scored) if isinstance(scored, str) else scored
    best = (F.array_position(scored, F.array_max(scored)) - 1).cast("int")
    return best if syllables is None else F.when(best < syllables, best)


def probabilities(scored: str | Column) -> Column:
    scored = F.col(scored) if isinstance(scored, str) else scored
    e = F.transform(scored, lambda v: F.exp(v - F.array_max(scored)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def walk_many(rows: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """rows with the scores of each model in a column of its name.  A task walks
    a tree with all rows of a batch at once: for models of many trees, for which
    the expression of scores() is long."""
    known = {name: model.collect() for name, model in models.items()}  # as many nodes as the settings allow
    features = sorted({r["name"] for nodes in known.values() for r in nodes if r["feature"] >= 0})
    place = {f: i for i, f in enumerate(features)}
    walks: dict[str, list] = {}
    for name, nodes in known.items():
        trees: dict[int, dict] = {}
        for r in nodes:
            trees.setdefault(r["tree"], {})[r["node"]] = r
        if not trees:
            raise ValueError("a model without nodes")
        walks[name] = []
        for _, t in sorted(trees.items()):
            of = [t[k] for k in sorted(t)]
            walks[name].append((of[0]["class"], *(np.array([default if r[c] is None else r[c] for r in of]) for c, default in (("threshold", 0.0), ("left", 0), ("right", 0), ("leaf", 0.0))), np.array([place[r["name"]] if r["feature"] >= 0 else -1 for r in of])))
    low, columns = F.lit(float("-inf")), rows.columns
    value = lambda n: F.when(F.col(n).cast("double").isNull() | F.isnan(F.col(n).cast("double")), low).otherwise(F.col(n).cast("double"))
    schema = rows.schema
    for name in walks:
        schema = StructType([*schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = batch.num_rows, []
            x = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if features else np.zeros((n, 1))
            for trees in walks.values():
                scores, at_row = np.zeros((n, max(t[0] for t in trees) + 1)), np.arange(n)
                for label, cut, left, right, leaf, f in trees:
                    at = np.zeros(n, np.int64)
                    while (inner := f[at] >= 0).any():
                        at = np.where(inner, np.where(x[at_row, np.maximum(f[at], 0)] <= cut[at], left[at], right[at]), at)
                    scores[:, label] += leaf[at]
                out.append(pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * scores.shape[1], scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *out], [*columns, *walks])

    return rows.withColumn("_x", F.array(*map(value, features)).cast("array<double>")).mapInArrow(run, schema)


def walk(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with scores (array by class) and yhat."""
    return rows.withColumn("scores", scores(model)).withColumn("yhat", answer("scores"))


def walk_recursive(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """key, class, score: the same walk as a recursive query over the table of
    nodes, one step of every tree a turn; keys are unique."""
    spark = rows.sparkSession
    features = [r["name"] for r in model.where("feature >= 0").select("name").distinct().collect()]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in features]), F.array(*[F.col(n).cast("double") for n in features])) if features else F.create_map().cast("map<string,double>")
    return spark.sql(
        """WITH RECURSIVE steps AS (
          SELECT r.k, r.x, m.tree, m.class, m.node, m.feature, m.leaf, CASE WHEN m.feature < 0 THEN NULL WHEN coalesce(nullif(r.x[m.name], double('NaN')), double('-Infinity')) <= m.threshold THEN m.`left` ELSE m.`right` END AS following FROM {rows} r JOIN {model} m ON m.node = 0
          UNION ALL
          SELECT s.k, s.x, m.tree, m.class, m.node, m.feature, m.leaf, CASE WHEN m.feature < 0 THEN NULL WHEN coalesce(nullif(s.x[m.name], double('NaN')), double('-Infinity')) <= m.threshold THEN m.`left` ELSE m.`right` END
          FROM steps s JOIN {model} m ON m.tree = s.tree AND m.node = s.following)
        SELECT k, class, sum(leaf) AS score FROM steps WHERE feature < 0 GROUP BY k, class""",
        rows=rows.select(F.col(key).alias("k"), pairs.alias("x")),
        model=model,
    ).withColumnRenamed("k", key)


# --- trials --------------------------------------------------------------------


def prunes(curves: DataFrame, warmup: int = 3, startup: int = 5) -> DataFrame:
    """trial, round, loss, median, pruned: the median rule over curves (trial,
    round, loss).  A trial is pruned at a round (from warmup on) at which its
    loss is above the median of the earlier trials' losses at that round, once
    startup of them were there."""
    curves = curves.select("trial", "round", F.col("loss").cast("double").alias("loss"))
    medians = curves.repartition("round").sortWithinPartitions("round", "trial")
    rows = medians.mapInArrow(_running_medians, _MEDIANS.format(*(curves.schema[c].dataType.simpleString() for c in ("trial", "round", "loss"))))
    return rows.select("trial", "round", "loss", "median", (F.coalesce(F.col("loss") > F.col("median"), F.lit(False)) & (F.col("_n") >= startup) & (F.col("round") >= warmup)).alias("pruned"))


_MEDIANS = "trial {}, round {}, loss {}, median double, _n long"


def _running_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by round and trial, with the median of the losses before each
    in its round, and their number.  Two heaps meet at the median; a task keeps
    the losses of one round, and no row.  A loss of nan counts as infinite."""
    now, low, high = _running_medians, [], []  # no round yet
    for batch in batches:
        medians, counts = [], []
        for key, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != now:
                now, low, high = key, [], []
            n = len(low) + len(high)
            counts.append(n)
            medians.append(None if not n else -low[0] if n % 2 else (-low[0] + high[0]) / 2)
            if loss is not None:
                loss = math.inf if math.isnan(loss) else loss
                heapq.heappush(high, -heapq.heappushpop(low, -loss))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(medians, pa.float64()), pa.array(counts, pa.int64())], [*batch.schema.names, "median", "_n"])


def median_rule(curves: dict[int, dict[int, float]], trial: int, warmup: int = 3, startup: int = 5) -> Callable[[int, float], bool]:
    """The same rule while a trial runs, as fit()'s stop; keeps its curve."""
    mine = curves.setdefault(trial, {})

    def stop(round_: int, loss: float) -> bool:
        mine[round_] = loss
        others = [c[round_] for k, c in list(curves.items()) if k < trial and round_ in c]
        return round_ >= warmup and len(others) >= startup and loss > float(np.median(others))

    return stop
