"""Ground-truth dynamics and their recovery: synthetic graphs, simulation, regressions on the
state, spectral clusters, and validation reports that chain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.modes import spectral_clusters
from tessera.sources.shared import Rounds

#: Acceptance thresholds of the reports.
LEAST_NMI, LEAST_ARI, MOST_P, LEAST_IC, LEAST_R2, LEAST_DIRECTION = 0.7, 0.6, 0.05, 0.05, 0.5, 0.55


def cluster_graph(spark: SparkSession, nodes: int, clusters: int, inside=(0.8, 1.0), between=(0.0, 0.1), density=(1.0, 0.05), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges i < j, labels) of a block graph.  Each pair draws its presence and weight from its
    own hash, so the graph doesn't depend on partitioning."""
    per = max(nodes // clusters, 1)
    label = F.when(F.col("i") < per * clusters, F.floor(F.col("i") / per)).otherwise(F.col("i") - per * clusters).cast("int")
    labels = spark.range(nodes).select(F.col("id").cast("int").alias("i")).withColumn("truth", label)
    pairs = labels.select("i", F.col("truth").alias("a")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))).where("i < j")
    pairs = pairs.join(labels.select(F.col("i").alias("j"), F.col("truth").alias("b")), "j")

    def draw(salt: int):
        return F.pmod(F.xxhash64("i", "j", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)

    same = F.col("a") == F.col("b")
    low, high = F.when(same, inside[0]).otherwise(between[0]), F.when(same, inside[1]).otherwise(between[1])
    keep = draw(1) < F.when(same, density[0]).otherwise(density[1])
    return pairs.where(keep).select("i", "j", (low + (high - low) * draw(2)).alias("w")), labels


def simulate(edges: DataFrame, nodes: int, steps: int, dt: float = 0.01, noise: float = 0.1, student: int | None = None, seed: int = 42) -> DataFrame:
    """(t, i, f) of df = -L f dt + noise.  Each step needs the one before, and a graph of a few
    hundred nodes is one small matrix, so the path is computed on the driver and dealt out."""
    import numpy as np
    import pandas as pd

    rng, lap = np.random.default_rng(seed), np.zeros((nodes, nodes))
    for i, j, w in edges.select("i", "j", "w").collect():
        lap[[i, j], [j, i]] -= w
        lap[[i, j], [i, j]] += w
    f = np.empty((steps, nodes))
    f[0] = rng.normal(size=nodes)
    shocks = rng.standard_t(student, (steps, nodes)) if student else rng.normal(size=(steps, nodes))
    for t in range(1, steps):
        f[t] = f[t - 1] - lap @ f[t - 1] * dt + noise * np.sqrt(dt) * shocks[t]
    t, i = np.divmod(np.arange(steps * nodes), nodes)
    return edges.sparkSession.createDataFrame(pd.DataFrame({"t": t.astype("int32"), "i": i.astype("int32"), "f": f.ravel()}))


#: Nodes whose regressions one task solves.
TARGETS = 64


def _lasso(gram, cross, penalty: float, sweeps: int):
    """Coordinate descent on products alone: each update moves the fitted part of every product."""
    import numpy as np

    beta, fitted = np.zeros(len(gram)), np.zeros(len(gram))
    for _ in range(sweeps):
        most = 0.0
        for d in range(len(gram)):
            rho = cross[d] - fitted[d] + gram[d, d] * beta[d]
            step = np.sign(rho) * max(abs(rho) - penalty, 0.0) / max(gram[d, d], 1e-12) - beta[d]
            if step:
                beta[d] += step
                fitted += step * gram[:, d]
                most = max(most, abs(step))
        if most < 1e-9:
            break
    return beta


def recover_graph(series: DataFrame, dt: float, ridge: float = 1e-6, lasso: float | None = None, sweeps: int = 200, most: int = 3000) -> DataFrame:
    """Edges i < j with positive weight from regressing each node's velocity on all states.

    Products of states are aggregated to one row a pair of nodes.  Each node's regression (ridge, or
    coordinate descent for the lasso) needs these products and its own with the velocity; TARGETS
    nodes are solved in a task, which holds the products of all pairs, so more than ``most`` nodes are an
    error.  The coefficients are symmetrised and cut at zero.
    """
    from pyspark.sql import Window

    graph.bounded_nodes(series, most)
    w = Window.partitionBy("i").orderBy("t")
    s = series.withColumn("v", (F.lead("f").over(w) - F.col("f")) / dt).where("v IS NOT NULL")
    a = s.select("t", "i", F.col("f").alias("x"))
    b = s.select("t", F.col("i").alias("j"), F.col("f").alias("y"), "v")
    tables = Rounds(series.sparkSession)
    sums = a.join(b, "t").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xx"), F.sum(F.col("x") * F.col("v")).alias("xv"), F.count("*").alias("n"))
    sums = tables.cut(sums)
    tasks = max(1, -(-series.select("i").distinct().count() // TARGETS))
    rows = sums.groupBy("i").agg(F.collect_list(F.struct("j", "xx")).alias("products"))  # a row a node
    rows = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    asked = sums.select(F.pmod(F.xxhash64("j"), F.lit(tasks)).cast("int").alias("task"), F.col("i").alias("node"), F.col("j").alias("target"), "xv", "n")
    kind = series.schema["i"].dataType.simpleString()

    def solve(products, wanted):
        import numpy as np
        import pandas as pd

        if not len(wanted):
            return pd.DataFrame(columns=["i", "j", "c"], dtype=object)
        names = sorted(products["i"])
        at = {x: k for k, x in enumerate(names)}
        gram = np.zeros((len(names), len(names)))
        for i, some in zip(products["i"], products["products"]):
            for p in some:
                gram[at[i], at[p["j"]]] = p["xx"]
        targets = sorted(set(wanted["target"]))
        place = {x: k for k, x in enumerate(targets)}
        cross = np.zeros((len(names), len(targets)))
        for node, target, xv in zip(wanted["node"], wanted["target"], wanted["xv"]):
            cross[at[node], place[target]] = xv
        if lasso is None:
            coef = np.linalg.solve(gram + ridge * np.eye(len(names)), cross)
        else:
            n = wanted.groupby("target")["n"].max()
            coef = np.column_stack([_lasso(gram, cross[:, k], lasso * n[x], sweeps) for x, k in place.items()])
        used = np.argwhere(coef != 0)
        return pd.DataFrame({"i": [names[p] for p, _ in used], "j": [targets[q] for _, q in used], "c": coef[used[:, 0], used[:, 1]]})

    coef = rows.groupBy("task").cogroup(asked.toDF(*asked.columns).groupBy("task")).applyInPandas(solve, f"i {kind}, j {kind}, c double")
    both = coef.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg((F.sum("c") / 2).alias("w"))
    return both.where("w > 0")


def weight_errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Frobenius error, its share of the truth's norm, and the correlation over true edges."""
    d = truth.select("i", "j", F.col("w").alias("t")).join(pred.select("i", "j", F.col("w").alias("p")), ["i", "j"], "full").fillna({"t": 0.0, "p": 0.0})
    e = F.sqrt(2 * F.sum((F.col("p") - F.col("t")) ** 2))
    x, y = F.when(F.col("t") > 0, F.col("t")), F.when(F.col("t") > 0, F.col("p"))
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return d.agg(e.alias("frobenius"), F.try_divide(e, F.sqrt(2 * F.sum(F.col("t") ** 2))).alias("frobenius_share"), F.coalesce(corr, F.lit(0.0)).alias("weight_correlation"))


def recovery_report(spark: SparkSession, nodes: int = 50, clusters: int = 5, steps: int = 1000, dt: float = 0.01, noise: float = 0.1, student: int | None = None, seed: int = 42) -> DataFrame:
    """Generator to recovered graph to clusters: edge scores, weight errors, agreement with the
    true clusters, and whether it passes, in one row."""
    truth, labels = cluster_graph(spark, nodes, clusters, seed=seed)
    pred = recover_graph(simulate(truth, nodes, steps, dt, noise, student, seed), dt)
    found = spectral_clusters(pred, clusters, seed)
    agree = graph.cluster_agreement(labels.join(found, "i"))
    scores = graph.edge_scores(pred, truth, nodes, 0.1)
    out = agree.join(scores).join(weight_errors(pred, truth))  # single rows
    return out.withColumn("passed", (F.col("nmi") > LEAST_NMI) & (F.col("ari") > LEAST_ARI))


def dynamics_report(edges: DataFrame, series: DataFrame, dt: float) -> DataFrame:
    """Does the force predict the velocity: IC with its t and p, fit through the origin, forecast
    errors, and a verdict: green if signal, fit and direction pass, yellow if some do, else red."""
    from pyspark.sql import Window

    w = Window.partitionBy("i").orderBy("t")
    f = graph.force(graph.both_ways(edges), series)
    pairs = f.withColumn("y", F.lead("f").over(w) - F.col("f")).where("y IS NOT NULL").select("t", "i", F.col("force").alias("x"), "y")
    ic = graph.ic_summary(graph.information_coefficients(pairs))
    fit = graph.regression_through_origin(pairs).drop("n")
    err = graph.forecast_errors(graph.euler_forecast(graph.both_ways(edges), series, dt))
    row = ic.join(fit).join(err).first()  # single rows
    p = graph.student_p(row.t_stat or 0.0, int(row.n) - 1) if row.n and row.n > 1 else 1.0
    passed = [p < MOST_P and (row.ic_mean or 0.0) > LEAST_IC, (row.r2 or 0.0) > LEAST_R2, (row.direction_accuracy or 0.0) > LEAST_DIRECTION]
    verdict = "green" if all(passed) else "yellow" if any(passed) else "red"
    spark = series.sparkSession
    names = "ic_mean double, ic_std double, t_stat double, p_value double, beta double, r2 double, mse double, direction_accuracy double, verdict string"
    return spark.createDataFrame([(row.ic_mean, row.ic_std, row.t_stat, p, row.beta, row.r2, row.mse, row.direction_accuracy, verdict)], names)


def sharpe_loss(pnl: DataFrame, turnover_weight: float = 0.0, leverage_weight: float = 0.0, ret: str = "daily_ret", year: int = 252) -> DataFrame:
    """The trading objective as a measure: minus Sharpe plus weighted turnover and leverage."""
    sharpe = F.try_divide(F.avg(ret) * F.sqrt(F.lit(float(year))), F.stddev_pop(ret) + 1e-8)
    return pnl.agg((-sharpe + turnover_weight * F.avg("turnover") + leverage_weight * F.avg("leverage")).alias("loss"))


def info_nce(pairs: DataFrame, temperature: float = 0.1, row: str = "i", other: str = "j", a: str = "a", b: str = "b") -> DataFrame:
    """Contrastive loss of two views of a batch: mean negative log share of each row's own pair
    among all of the batch, from unit vectors.  A batch is small; its pairs are the loss itself."""
    from tessera.functions.columns import dot, unit

    left = pairs.select(F.col(row).alias("_i"), unit(F.col(a)).alias("_a"))
    right = pairs.select(F.col(row).alias("_j"), unit(F.col(b)).alias("_b"))
    sims = left.join(right, F.lit(True)).withColumn("s", F.exp(dot(F.col("_a"), F.col("_b")) / temperature))
    per = sims.groupBy("_i").agg(F.sum(F.when(F.col("_i") == F.col("_j"), F.col("s"))).alias("own"), F.sum("s").alias("all"))
    return per.agg(F.avg(-F.log(F.col("own") / F.col("all"))).alias("loss"))


def cluster_entropy(shares: DataFrame, share: str = "share") -> DataFrame:
    """Entropy of the mean assignment: high if all clusters are used."""
    mean = shares.select(F.posexplode(share).alias("k", "p")).groupBy("k").agg(F.avg("p").alias("p"))
    return mean.agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"))


def mean_reversion_nll(residuals: DataFrame, kappa: float, sigma: float, dt: float = 1.0, entity: str = "i", time: str = "t", value: str = "f") -> DataFrame:
    """Mean negative log-likelihood of residuals as an Ornstein-Uhlenbeck path."""
    import math

    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(entity).orderBy(time))
    decay = math.exp(-kappa * dt)
    var = sigma**2 * (1 - decay**2) / (2 * kappa)
    z = F.col(value) - before * decay
    return residuals.withColumn("_z", z).where("_z IS NOT NULL").agg(F.avg(F.col("_z") ** 2 / (2 * var) + 0.5 * math.log(2 * math.pi * var)).alias("nll"))


def augment(df: DataFrame, features: list[str], mask: float = 0.1, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Features zeroed with the mask's probability and jittered."""
    return df.withColumns({f: F.when(F.rand(seed + 2 * k) < mask, 0.0).otherwise(F.col(f) + noise * F.randn(seed + 2 * k + 1)) for k, f in enumerate(features)})
