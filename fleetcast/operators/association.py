"""Association between categories (chi-square, Cramér V) and of a value with groups (Kruskal-Wallis)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.significance import chi2_p_value
from fleetcast.operators.ordered import average_ranks, ranked_histogram
from fleetcast.operators.reshape import contingency
from fleetcast.session import stage


def chi2_cramer(df: DataFrame, a: str, b: str, *, yates: bool = True) -> DataFrame:
    """Chi-square of independence, bias-corrected Cramér V and cells with expected count < 5.

    Works on the non-empty cells: an empty cell adds exactly its expected count, so the full
    grid of categories is never built. The continuity correction applies to 2 x 2 tables only.
    """
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    a, b = "_a", "_b"
    cells = stage(contingency(pairs, a, b))
    rows = cells.groupBy(a).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("c"))
    size = rows.agg(F.count(F.lit(1)).alias("n_r"), F.sum("r").alias("n")).first()
    n, n_r, n_c = size["n"] or 0, size["n_r"], cols.count()
    expected = F.col("r") * F.col("c") / F.lit(float(n or 1))
    placed = cells.join(rows, a).join(cols, b).withColumn("e", expected)
    if yates and n_r == 2 and n_c == 2:
        # four cells at most: the table is completed from its margins
        r = rows.withColumn("_one", F.lit(1))
        c = cols.withColumn("_one", F.lit(1))
        grid = r.join(c, "_one").join(cells, [a, b], "left").withColumn("e", expected)
        gap = F.abs(F.coalesce("n", F.lit(0)) - F.col("e"))
        stat = grid.agg(
            F.sum(F.pow(gap - F.least(gap, F.lit(0.5)), F.lit(2)) / F.col("e")).alias("chi2")
        )
    else:
        stat = placed.agg(
            (
                F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2)) / F.col("e")) + n - F.sum("e")
            ).alias("chi2")
        )
    low = _low_cells(rows, cols, n)
    dof = (n_r - 1) * (n_c - 1)
    less = max(n - 1, 1)
    r_corr = n_r - (n_r - 1) ** 2 / less
    c_corr = n_c - (n_c - 1) ** 2 / less
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / (n or 1) - dof / less)
    joined = stat.withColumn("_one", F.lit(1)).join(low.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        F.lit(n).cast("long").alias("n"),
        "chi2",
        F.lit(dof).alias("dof"),
        F.sqrt(phi2 / max(1e-12, min(r_corr - 1, c_corr - 1))).alias("cramers_v"),
        F.col("low").alias("n_low_expected"),
        chi2_p_value(F.col("chi2"), F.lit(float(dof))).alias("p_chi2"),
    )


def _low_cells(rows: DataFrame, cols: DataFrame, n: int) -> DataFrame:
    """Cells with expected count r * c / n < 5, counted by ranking margins instead of pairing them."""
    # integer form: c < ceil(5 n / r)
    limit = F.floor((F.lit(5 * n) + F.col("r") - 1) / F.col("r")).cast("long")
    line = rows.select(limit.alias("v"), F.lit(0).alias("is_c"), F.lit(1).alias("is_r")).unionByName(
        cols.select(F.col("c").alias("v"), F.lit(1).alias("is_c"), F.lit(0).alias("is_r"))
    )
    ranked = ranked_histogram(
        line.withColumn("_all", F.lit(0)), ["_all"], "v", {"cs": F.col("is_c"), "rs": F.col("is_r")}
    )
    return ranked.agg(
        F.coalesce(F.sum(F.col("rs") * F.col("cs_before")), F.lit(0)).alias("low")
    )


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) and its effect size epsilon squared.

    Rows without a group or value are left out.
    """
    df = df.select(F.col(group).alias("_group"), F.col(value).alias("_value"))
    group, value = "_group", "_value"
    cells = stage(
        df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("m"))
    )
    ranks = average_ranks(cells.withColumn("_all", F.lit(0)), ["_all"], value, count=F.col("m"))
    mean_rank = (F.col("n_total") + 1) / 2
    centred = ranks.select(
        value, "n_total", (F.col("avg_rank") - mean_rank).alias("d")
    )
    per_group = (
        cells.join(centred, value)
        .groupBy(group)
        .agg(
            F.sum("m").alias("g"),
            F.sum(F.col("m") * F.col("d")).alias("s"),
            F.max("n_total").alias("n"),
        )
    )
    between = per_group.agg(
        F.count(F.lit(1)).alias("k"),
        F.max("n").alias("n"),
        F.sum(F.col("s") * F.col("s") / F.col("g")).alias("ss"),
    )
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"))
    one = between.withColumn("_one", F.lit(1)).join(ties.withColumn("_one", F.lit(1)), "_one")
    n = F.col("n").cast("double")
    h = 12 * F.col("ss") / (n * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    k = F.col("k")
    return one.withColumn("h", h).select(
        F.col("n").alias("n"),
        k.alias("k"),
        F.col("h").alias("kruskal_h"),
        F.when(F.col("n") > k, (F.col("h") - k + 1) / (n - k)).otherwise(0.0).alias("epsilon2"),
        chi2_p_value(F.col("h"), (k - 1).cast("double")).alias("p_kruskal"),
    )
