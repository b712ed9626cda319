"""Feature importance: exact attributions of linear and tree models, permutation importance, tables and comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.operators.boosting import Tree, TreeModel
from fleetcast.operators.evaluate import average_precision
from fleetcast.operators.models import SCORE
from fleetcast.operators.ordered import IDX, number_order
from fleetcast.session import stage


def clean_names(df: DataFrame, col: str = "feature") -> DataFrame:
    """Feature names without their transformer prefix."""
    return df.withColumn(col, F.regexp_replace(col, "^(num__|cat__)", ""))


def linear_attributions(
    df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """(feature, attribution) per row: coefficient times distance from the mean."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("attribution"),
        )
        for c, w in coefficients.items()
    ]
    return df.select(F.inline(F.array(*parts)))


def importance_table(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and its share (0 when all are 0), largest first."""
    return _shared(attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")))


def _shared(table: DataFrame) -> DataFrame:
    """Add the share of each feature (0 when all are 0); the table has one row per feature."""
    total = F.sum("mean_abs").over(Window.partitionBy(F.lit(0)))
    share = F.when(total > 0, F.col("mean_abs") / total).otherwise(0.0)
    return table.withColumn("importance_share", share).orderBy(F.desc("mean_abs"), "feature")


def compare_importance(first: DataFrame, second: DataFrame, top_n: int = 15) -> DataFrame:
    """Two importance tables side by side: shares, ranks and rank change of the union of their top n.

    A feature missing on one side gets the worst rank plus one and a share of 0. Tables have
    one row per feature.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "feature")

    def ranked(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "feature",
            F.col("mean_abs").alias(f"mean_abs_{tag}"),
            F.col("importance_share").alias(f"share_{tag}"),
            F.row_number().over(order).alias(f"rank_{tag}"),
        )

    a, b = ranked(first, "first"), ranked(second, "second")
    everyone = Window.partitionBy(F.lit(0))
    merged = a.join(b, "feature", "full_outer").withColumn(
        "_worst",
        F.greatest(
            F.count("rank_first").over(everyone), F.count("rank_second").over(everyone)
        ).cast("int") + 1,
    )
    filled = merged.select(
        "feature",
        *[F.coalesce(f"{m}_{t}", F.lit(0.0)).alias(f"{m}_{t}") for m in ("mean_abs", "share") for t in ("first", "second")],
        *[F.coalesce(f"rank_{t}", "_worst").alias(f"rank_{t}") for t in ("first", "second")],
        (F.coalesce(F.col("rank_first"), F.col("_worst") + top_n) <= top_n).alias("_in_first"),
        (F.coalesce(F.col("rank_second"), F.col("_worst") + top_n) <= top_n).alias("_in_second"),
    )
    return (
        filled.filter("_in_first or _in_second")
        .drop("_in_first", "_in_second")
        .withColumn("delta_rank", F.col("rank_first") - F.col("rank_second"))
        .orderBy(F.desc("share_second"), "feature")
    )


def permutation_importance(fitted, df: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    """Loss of average precision when one feature is shuffled, per feature.

    Columns are shuffled by pairing two dense numberings of the rows, one in ``order`` and one in a
    seeded hash order: two distributed sorts and one join, whatever the number of features. All shuffled
    scores are ranked in one job.
    """
    label = fitted.features.label
    names = [*fitted.features.numeric, *fitted.features.categorical]
    rows = number_order(df, order)
    mixed = number_order(df.withColumn("_mix", F.xxhash64(F.lit(seed), *order)), ["_mix", *order])
    donors = mixed.select(IDX, F.struct(*[F.col(c) for c in names]).alias("_donor"))
    paired = stage(rows.join(donors, IDX).drop(IDX))
    scored = None
    for feature in [None, *names]:
        shuffled = paired if feature is None else paired.withColumn(feature, F.col(f"_donor.{feature}"))
        part = fitted.score(shuffled.drop("_donor")).select(F.lit(feature or "").alias("feature"), label, SCORE)
        scored = part if scored is None else scored.unionByName(part)
    got = {r["feature"]: r["average_precision"] for r in average_precision(stage(scored), label, SCORE, ["feature"]).collect()}  # a row a feature
    return df.sparkSession.createDataFrame([(c, float(got[""] - got[c])) for c in names], "feature string, attribution double")


# --- attributions of trees ---------------------------------------------------------------------

#: up to this many columns on a path, attributions of all patterns of met conditions are tabled
_TABLED = 8


class Paths:
    """Paths of a tree's leaves: per leaf the codes that each column may have, and the share of cover behind each."""

    def __init__(self, tree: Tree):
        self.leaves: list[tuple[float, list[int], list[int], list[int], np.ndarray]] = []
        stack: list[tuple[int, dict[int, tuple[int, int, float]]]] = [(0, {})]
        while stack:
            node, held = stack.pop()
            c = int(tree.column[node])
            if c < 0:
                ranges = list(held.values())
                cols, low, high = list(held), [r[0] for r in ranges], [r[1] for r in ranges]
                self.leaves.append((float(tree.value[node]), cols, low, high, np.array([r[2] for r in ranges])))
                continue
            a, b, share = held.get(c, (-1, 256, 1.0))
            left, cut = int(tree.left[node]), int(tree.bin[node])
            for child, bounds in ((left, (a, min(b, cut))), (left + 1, (max(a, cut), b))):
                stack.append((child, {**held, c: (*bounds, share * float(tree.cover[child] / tree.cover[node]))}))
        self._tabled: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def tabled(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Per column of a leaf's path: its bit of the pattern for each code, and its attribution for each pattern."""
        if leaf not in self._tabled:
            value, cols, low, high, z = self.leaves[leaf]
            d, code = len(cols), np.arange(256)
            bits = [((code > a) & (code <= b)).astype(np.uint8) << j for j, (a, b) in enumerate(zip(low, high, strict=True))]
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
            self._tabled[leaf] = np.array(bits, np.uint8), np.ascontiguousarray((value * _shares(patterns.astype(float), z)).T)
        return self._tabled[leaf]

    @property
    def base(self) -> float:
        """Mean of the leaves under the covers."""
        return sum(v * float(np.prod(z)) for v, _, _, _, z in self.leaves)


def _shares(met: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for rows of met conditions (rows x columns of the path).

    The weight of a coalition of k of d columns is the integral of t**k (1 - t)**(d - 1 - k), so the value of column i
    is (met_i - z_i) times the integral of the product of met_j t + z_j (1 - t) over the other columns: a
    polynomial, which Gauss-Legendre points integrate exactly.
    """
    d = met.shape[1]
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    out = np.zeros(met.shape)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        factor = met * t + z * (1 - t)
        out += w * factor.prod(axis=1, keepdims=True) / factor
    return out * (met - z)


def tree_shapley(trees: Sequence[Tree], codes: np.ndarray, paths: Sequence[Paths] | None = None) -> tuple[np.ndarray, float]:
    """Attributions of each row to each column, and the base; both add up to the margin."""
    # a line a column: the work of a leaf goes over whole lines
    lines, out, base = np.ascontiguousarray(codes.T), np.zeros(codes.T.shape), 0.0
    for part in paths or [Paths(t) for t in trees]:
        base += part.base
        for leaf, (value, cols, low, high, z) in enumerate(part.leaves):
            if not cols or value == 0.0:
                continue
            d = len(cols)
            if d <= _TABLED:
                bits, table = part.tabled(leaf)
                pattern = bits[0][lines[cols[0]]]
                for j in range(1, d):
                    pattern |= bits[j][lines[cols[j]]]
                for j, c in enumerate(cols):
                    out[c] += table[j][pattern]
            else:
                met = np.stack([(lines[c] > a) & (lines[c] <= b) for c, a, b in zip(cols, low, high, strict=True)], axis=1)
                out[cols] += (value * _shares(met.astype(float), z)).T
    return np.ascontiguousarray(out.T), base


def _spread(df: DataFrame) -> DataFrame:
    """Few partitions of rows are dealt out over all cores: a row costs far more than its move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tree_attributions(df: DataFrame, model: TreeModel, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: ``keep``, the margin, the base and one attribution per column of the codes (``model.bins.names``)."""
    columns = [*model.bins.limits, *model.bins.levels]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [Paths(t) for t in model.trees]
        for batch in batches:
            codes = model.bins.codes(batch)
            phi, base = tree_shapley(model.trees, codes, paths)
            n, width = phi.shape
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(phi.ravel()))
            made = [batch.column(batch.schema.get_field_index(f"_keep_{c}")) for c in keep]
            yield pa.record_batch([*made, pa.array(model.margins(codes)), pa.array(np.full(n, base)), listed], names=[*keep, "margin", "base", "attributions"])

    rows = df.select(*columns, *[F.col(c).alias(f"_keep_{c}") for c in keep])
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return _spread(rows).mapInArrow(explain, f"{kinds}margin double, base double, attributions array<double>")


def tree_importance(df: DataFrame, model: TreeModel) -> DataFrame:
    """Importance table of the rows' attributions: absolute values are added up per batch, then merged."""
    columns, names = [*model.bins.limits, *model.bins.levels], model.bins.names

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [Paths(t) for t in model.trees]
        total, n = np.zeros(len(names)), 0
        for batch in batches:
            phi, _ = tree_shapley(model.trees, model.bins.codes(batch), paths)
            total, n = total + np.abs(phi).sum(axis=0), n + len(phi)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(total), pa.array(np.full(len(names), n))], names=["feature", "total", "n"])

    sums = _spread(df.select(*columns)).mapInArrow(add_up, "feature string, total double, n long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    # one row per feature
    return _shared(sums.select("feature", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("mean_abs")))
