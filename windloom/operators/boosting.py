"""Gradient-boosted trees with vector leaves, many groups (farms) at once, every level of a tree from one distributed aggregate.

Rows (features x, outputs y: arrays) are kept as blocks of a few thousand of one group: binned features as bytes, outputs and present
predictions as doubles.  For a level, tasks add up histograms of residual vectors by (group, node, feature, bin); these are summed per
feature, every feature names its best cut, and the best feature of a node is chosen: all of a group's outputs share the tree's cuts
and each leaf holds a vector.  A group's histograms meet feature by feature, so no task holds a group.  Where a group has few rows
(``TASK_ROWS``) its sums have one summand, and the task that holds it grows its trees by the same steps, without a job a level.

Only the trees reach the driver: per group a few kilobytes a tree; groups are fitted in lots so that what it holds is bounded.
Ties go to the smaller feature, then the smaller cut.  Rows with nulls in x or y are left out of the fit and predicted as null; a
group with fewer than two rows has no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.session import stored

#: Bins of a feature; rows of a block; rows of a group that one task grows; trees grown between two writes of the predictions; groups
#: fitted together; histograms that a task holds before it hands them on.
BINS, BLOCK_ROWS, TASK_ROWS, TREES_KEPT, LOT, HELD = 64, 4096, 32_768, 10, 64, 64


@dataclass
class Tree:
    """A complete tree: feature (-1: all rows go left) and bin of each inner node, in level order (rows up to the bin go left), and the
    vectors of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row on the level ``depth``, from 0."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(depth):
            inner = at + (1 << level) - 1
            f = self.feature[inner]
            at = 2 * at + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > self.cut[inner]))
        return at

    @property
    def depth(self) -> int:
        return len(self.leaf).bit_length() - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, self.depth)]


@dataclass
class Boosted:
    """Per group: the features' bin edges, the mean of the outputs and the trees; leaves already hold the learning rate."""

    group: str
    edges: dict = field(default_factory=dict)
    base: dict = field(default_factory=dict)
    trees: dict = field(default_factory=dict)

    def binned(self, g, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges[g])], 1).astype(np.uint8)

    def predict_rows(self, g, x: np.ndarray) -> np.ndarray:
        bins = self.binned(g, x)
        return self.base[g] + sum((t.predict(bins) for t in self.trees[g]), np.zeros((len(x), len(self.base[g]))))

    def predict(self, rows: DataFrame, x: str = "x", name: str = "predicted") -> DataFrame:
        """``rows`` with the array of outputs; null for groups without a model and for rows with missing features."""
        group, model = self.group, self
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` array<double>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pd.Series([None] * len(pdf), dtype=object)
                for g, places in pdf.groupby(group).indices.items():
                    if g not in model.edges:
                        continue
                    own = np.array([[np.nan if v is None else v for v in r] for r in pdf[x].iloc[places]], float)
                    whole = ~np.isnan(own).any(axis=1)
                    if whole.any():
                        made = model.predict_rows(g, own[whole])
                        for k, v in zip(places[whole], made, strict=True):
                            out.iloc[k] = v.tolist()
                yield pdf.assign(**{name: out.to_numpy()})

        return rows.mapInPandas(run, schema)


def _whole(c: str) -> F.Column:
    return F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v))


def _blocks(rows: DataFrame, group: str, model: Boosted) -> DataFrame:
    """``(group, n, bins, y, f)`` of rows(group, x, y) in blocks of one group; f: predictions, at first the mean."""
    numbered = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    lists = numbered.groupBy(group, F.floor(F.col("__row") / BLOCK_ROWS).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("__row", "x", "y"))).alias("l"))
    kind = dict(rows.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for g, x, y in zip(pdf[group], pdf["x"], pdf["y"], strict=True):
                x, y = np.array([list(r) for r in x], float), np.array([list(r) for r in y], float)
                made.append((g, len(x), model.binned(g, x).tobytes(), y.tobytes(), np.tile(model.base[g], (len(x), 1)).tobytes()))
            yield pd.DataFrame(made, columns=[group, "n", "bins", "y", "f"])

    return stored(lists.select(group, F.col("l.x").alias("x"), F.col("l.y").alias("y")).mapInPandas(run, f"`{group}` {kind}, n long, bins binary, y binary, f binary"), "blocks")


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.bins, np.uint8).reshape(r.n, -1), np.frombuffer(r.y, float).reshape(r.n, -1), np.frombuffer(r.f, float).reshape(r.n, -1)


def _histograms(bins: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """(node, feature, bin, 1 + outputs): rows and sums of residuals."""
    rows, features = bins.shape
    out = np.zeros((nodes, features, BINS, 1 + residual.shape[1]))
    key = ((node[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    out[..., 0] = np.bincount(key, minlength=nodes * features * BINS).reshape(out.shape[:3])
    for j in range(residual.shape[1]):
        out[..., 1 + j] = np.bincount(key, np.repeat(residual[:, j], features), nodes * features * BINS).reshape(out.shape[:3])
    return out


def best_cut(hist: np.ndarray, least: int) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """Of one node's (feature, bin, 1 + outputs): (gain, feature, bin, left, right), left and right being rows and sums; gain 0 without a
    cut that leaves ``least`` rows on both sides.  The gain is the fall of the summed squared residuals."""
    left = hist.cumsum(1)
    whole = left[:, -1:]
    right = whole - left
    able = (left[..., 0] >= least) & (right[..., 0] >= least)
    square = lambda s: (s[..., 1:] ** 2).sum(-1) / np.maximum(s[..., 0], 1)
    gain = np.where(able, square(left) + square(right) - square(whole), 0.0)
    k, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[k, b]), int(k), int(b), left[k, b], right[k, b]


def _empty(depth: int, outputs: int) -> Tree:
    inner = (1 << depth) - 1
    return Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros((1 << depth, outputs)))


def _set_cut(tree: Tree, level: int, node: int, rate: float, gain: float, feature: int, cut: int, left: np.ndarray, right: np.ndarray) -> None:
    """Cuts a node and sets the leaves below it to the means of its sides; without a gain its rows stay together."""
    half = 1 << (tree.depth - level - 1)
    ends = (left, right) if gain > 0 else (left + right, left + right)
    if gain > 0:
        tree.feature[(1 << level) - 1 + node], tree.cut[(1 << level) - 1 + node] = feature, cut
    for side, s in enumerate(ends):
        tree.leaf[(2 * node + side) * half : (2 * node + side + 1) * half] = rate * s[1:] / max(s[0], 1)


def grown(bins: np.ndarray, y: np.ndarray, base: np.ndarray, trees: int, depth: int, rate: float, least: int) -> list[Tree]:
    """The trees of rows that are all at hand."""
    f, out = np.tile(base, (len(y), 1)), []
    for _ in range(trees):
        tree = _empty(depth, y.shape[1])
        for level in range(depth):
            for node, hist in enumerate(_histograms(bins, y - f, tree.nodes(bins, level), 1 << level)):
                if hist[0, :, 0].any():
                    _set_cut(tree, level, node, rate, *best_cut(hist, least))
        f += tree.predict(bins)
        out.append(tree)
    return out


def _level(blocks: DataFrame, group: str, trees: dict, depth: int, least: int) -> list:
    """The best cut of every (group, node) of a level: (group, node, gain, feature, cut, left, right)."""
    kind = dict(blocks.dtypes)[group]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def handed_on() -> pd.DataFrame:
            made = [(g, node, k, one.tobytes()) for g, hist in held.items() for node in range(len(hist)) if hist[node, 0, :, 0].any() for k, one in enumerate(hist[node])]
            held.clear()
            return pd.DataFrame(made, columns=[group, "node", "feature", "hist"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                g = getattr(r, group)
                bins, y, f = _arrays(r)
                own = trees[g]
                for t in own[:-1]:
                    f = f + t.predict(bins)
                made = _histograms(bins, y - f, own[-1].nodes(bins, depth), 1 << depth)
                held[g] = held[g] + made if g in held else made
                if len(held) >= max(1, HELD >> depth):
                    yield handed_on()
        if held:
            yield handed_on()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All histograms of a (group, node, feature) are in one partition; it names the best of the features that it has."""
        total: dict = {}
        for pdf in batches:
            for g, node, k, h in pdf.itertuples(index=False, name=None):
                own, hist = total.setdefault((g, node), {}), np.frombuffer(h, float)
                own[k] = own[k] + hist if k in own else hist
        made = []
        for (g, node), own in total.items():
            features = sorted(own)
            gain, at, bin_, left, right = best_cut(np.stack([own[k] for k in features]).reshape(len(own), BINS, -1), least)
            made.append((g, node, gain, features[at], bin_, left.tolist(), right.tolist()))
        yield pd.DataFrame(made, columns=[group, "node", "gain", "feature", "cut", "left", "right"])

    hists = blocks.mapInPandas(gather, f"`{group}` {kind}, node int, feature int, hist binary").repartition(group, "node", "feature")
    best: dict = {}
    for r in hists.mapInPandas(cut, f"`{group}` {kind}, node int, gain double, feature int, cut int, `left` array<double>, `right` array<double>").collect():
        key = (r[group], r.node)
        if key not in best or (-r.gain, r.feature) < (-best[key].gain, best[key].feature):
            best[key] = r
    return list(best.values())


def boosted(rows: DataFrame, group: str, trees: int = 100, depth: int = 4, rate: float = 0.1, least: int = 20) -> Boosted:
    """A model of ``rows(group, x array, y array)``: ``trees`` trees of ``depth`` levels for every group."""
    own = rows.where(F.col(group).isNotNull() & _whole("x") & _whole("y")).select(group, "x", "y")
    sizes = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("features"), F.max(F.size("y")).alias("outputs")).where("n > 1")
    model = Boosted(group)
    counts = {r[group]: r.n for r in sizes.select(group, "n").collect()}
    small, large = (sorted(g for g, n in counts.items() if (n <= TASK_ROWS) == few) for few in (True, False))
    for names, fit in ((small, _fit_in_tasks), (large, _fit_by_levels)):
        for a in range(0, len(names), LOT):
            lot = own.where(F.col(group).isin(names[a : a + LOT]))
            first = lot.select(F.size("x").alias("x"), F.size("y").alias("y")).first()
            at = [k / BINS for k in range(1, BINS)]
            edges = [F.percentile_approx(F.col("x")[k], at, 10_000).alias(f"e{k}") for k in range(first.x)]
            for r in lot.groupBy(group).agg(*edges, *[F.avg(F.col("y")[j]).alias(f"m{j}") for j in range(first.y)]).collect():
                model.edges[r[group]] = [np.unique(r[f"e{k}"]) for k in range(first.x)]
                model.base[r[group]] = np.array([r[f"m{j}"] for j in range(first.y)])
                model.trees[r[group]] = []
            fit(lot, model, trees, depth, rate, least)
    return model


def _fit_in_tasks(rows: DataFrame, model: Boosted, trees: int, depth: int, rate: float, least: int) -> None:
    group = model.group
    kind = dict(rows.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[group].iloc[0]
        x, y = np.array([list(r) for r in pdf["x"]], float), np.array([list(r) for r in pdf["y"]], float)
        order = np.lexsort(np.concatenate([y, x], 1).T)
        made = grown(model.binned(g, x[order]), y[order], model.base[g], trees, depth, rate, least)
        return pd.DataFrame({group: [g] * trees, "tree": range(trees), "feature": [t.feature.tolist() for t in made], "cut": [t.cut.tolist() for t in made], "leaf": [t.leaf.tobytes() for t in made]})

    found = rows.groupBy(group).applyInPandas(run, f"`{group}` {kind}, tree int, feature array<long>, cut array<long>, leaf binary")
    for r in sorted(found.collect(), key=lambda r: r.tree):
        leaf = np.frombuffer(r.leaf, float)
        model.trees[r[group]].append(Tree(np.array(r.feature), np.array(r.cut), leaf.reshape(1 << depth, -1)))


def _fit_by_levels(rows: DataFrame, model: Boosted, trees: int, depth: int, rate: float, least: int) -> None:
    group = model.group
    own: dict = {g: [] for g in {r[group] for r in rows.select(group).distinct().collect()}}
    blocks = _blocks(rows, group, model)
    for made in range(trees):
        for g in own:
            own[g].append(_empty(depth, len(model.base[g])))
        for level in range(depth):
            for r in _level(blocks, group, own, level, least):
                _set_cut(own[r[group]][-1], level, r.node, rate, r.gain, r.feature, r.cut, np.array(r.left), np.array(r.right))
        if (made + 1) % TREES_KEPT == 0 or made == trees - 1:
            for g, done in own.items():
                model.trees[g] += done
            if made < trees - 1:
                blocks = _moved_on(blocks, group, {g: list(t) for g, t in own.items()})
            own = {g: [] for g in own}


def _moved_on(blocks: DataFrame, group: str, trees: dict) -> DataFrame:
    """The blocks with their predictions after more trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                bins, _, f = _arrays(r)
                made.append((f + sum(t.predict(bins) for t in trees[getattr(r, group)])).tobytes())
            yield pdf.assign(f=made)

    return stored(blocks.mapInPandas(run, blocks.schema), "blocks")


def recursive(model: Boosted, origins: DataFrame, lags: list[int], steps: int = 24, history: str = "history") -> DataFrame:
    """``(group, origin, lead, predicted)``: forecasts 1 to ``steps`` rows ahead of every origin, each made from the ones before it, by
    a model of one output on the values ``lags`` rows before.  ``origins(group, origin, history array)``, newest value last; a task
    walks all steps of the origins that it has, all of a group together.  Origins with a shorter history, or with nulls in it, have
    no forecasts."""
    group = model.group
    kinds = dict(origins.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, own in pdf.groupby(group):
                if g not in model.edges:
                    continue
                whole = [h is not None and len(h) >= max(lags) and all(v is not None and v == v for v in h[-max(lags) :]) for h in own[history]]
                own = own[whole]
                if not len(own):
                    continue
                past = np.array([list(h[-max(lags) :]) for h in own[history]], float)
                for _ in range(steps):
                    past = np.concatenate([past, model.predict_rows(g, past[:, [-k for k in lags]])], axis=1)
                made = past[:, -steps:]
                yield pd.DataFrame({group: np.repeat(own[group].to_numpy(), steps), "origin": np.repeat(own["origin"].to_numpy(), steps), "lead": np.tile(np.arange(1, steps + 1), len(own)), "predicted": made.ravel()})

    return origins.select(group, "origin", history).mapInPandas(run, f"`{group}` {kinds[group]}, origin {kinds['origin']}, lead int, predicted double")
