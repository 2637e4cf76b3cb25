"""Training of differentiable clusters on a trading objective.

Forward: unit feature vectors, cosine similarities to normalised centres, softmax shares and a gate
for outliers; a consensus of the last standardised value in each cluster of a cross-section; the
residual from it, a position against it between entry and stop; weights, net returns, and minus
their Sharpe ratio plus penalties for turnover and leverage.

The gradient is derived by hand.  The objective is a function of a few sums over time, and its
slope in a period's return is linear in that return.  Rows lie in blocks of some times and some
entities, so a task's memory does not grow with a cross-section; what a cross-section shares goes
through sums by time.  A step takes four passes: the consensus, the returns and turnover of each
time, the derivatives by the consensus, and the four sums of derivatives the size of the centres.  Tasks
pass on a few numbers a time; the driver holds those, a row a time, the centres and the moments of Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import window_models
from tessera.sources.shared import Rounds


#: Entities of a block, on average.
ENTITIES = 512


@dataclass(frozen=True)
class Settings:
    """Constants of the system and its objective."""

    temperature: float = 1.0
    similarity: float = 0.5
    gate_scale: float = 20.0
    entry: float = 2.0
    stop: float = 4.0
    scale: float = 5.0
    share: float = 0.1
    cost: float = 0.001
    turnover_penalty: float = 0.5
    leverage_penalty: float = 1.0
    most_leverage: float = 5.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class CrossSection:
    """Some entities of one time: their part of the consensus, then, given that of all, their weights and
    the derivatives against an upstream one of the weights."""

    def __init__(self, x: np.ndarray, z: np.ndarray, centres: np.ndarray, s: Settings):
        self.x, self.z, self.s = x, z, s
        self.sim = x @ centres.T
        self.top = self.sim.argmax(axis=1)
        self.gate = _sigmoid(s.gate_scale * (self.sim.max(axis=1) - s.similarity))
        e = np.exp((self.sim - self.sim.max(axis=1, keepdims=True)) / s.temperature)
        self.share = e / e.sum(axis=1, keepdims=True)

    def gated(self) -> np.ndarray:
        """Gated shares of each cluster, then the same times the last values, summed over these entities."""
        g = self.share * self.gate[:, None]
        return np.concatenate([g.sum(axis=0), (g * self.z[:, None]).sum(axis=0)])

    def trade(self, gated: np.ndarray) -> np.ndarray:
        """The weights, given ``gated`` of all entities of the time."""
        s = self.s
        self.total = gated[: len(gated) // 2] + 1e-6
        self.consensus = gated[len(gated) // 2 :] / self.total
        self.signal = self.z - self.share @ self.consensus
        size = np.abs(self.signal)
        self.above, self.below = _sigmoid(s.scale * (size - s.entry)), 1.0 - _sigmoid(s.scale * (size - s.stop))
        self.way = -np.tanh(s.scale * self.signal)
        return s.share * self.way * self.above * self.below * self.gate

    def residual(self, up: np.ndarray) -> np.ndarray:
        """Derivative of the sum of ``up`` times the weights by minus the expected values."""
        s, band = self.s, self.above * self.below
        in_band = s.scale * np.sign(self.signal) * (self.above * (1 - self.above) * self.below - self.above * self.below * (1 - self.below))
        return s.share * up * self.gate * (-s.scale * (1 - self.way**2) * band + self.way * in_band)

    def by_consensus(self, up: np.ndarray) -> np.ndarray:
        return -(self.residual(up) @ self.share)

    def backward(self, up: np.ndarray, consensus: np.ndarray | None) -> np.ndarray:
        """Derivative by the normalised centres of the sum of ``up`` times the weights, and, if the time is the
        block's own, of the part that goes through the consensus: ``by_consensus`` of all entities."""
        s = self.s
        gate = s.share * up * self.way * self.above * self.below
        share = -self.residual(up)[:, None] * self.consensus[None]
        if consensus is not None:
            gated = np.outer(self.z, consensus / self.total) - (consensus * self.consensus / self.total)[None]
            share = share + gated * self.gate[:, None]
            gate = gate + (gated * self.share).sum(axis=1)
        sim = self.share * (share - (share * self.share).sum(axis=1, keepdims=True)) / s.temperature
        sim[np.arange(len(sim)), self.top] += gate * s.gate_scale * self.gate * (1 - self.gate)
        return sim.T @ self.x


class Block:
    """Some entities at ``low`` to ``high`` and the time before: what each pass takes from them.  A time is
    (t, places, x, z, ret); ``all_times`` are those that any entity has.  Where the time before is
    missing from them, nothing was held."""

    def __init__(self, low: int, high: int, n_entities: int, times: list[tuple], centres: np.ndarray, s: Settings):
        self.low, self.high, self.n, self.s = low, high, n_entities, s
        self.times = {t: (at, ret, CrossSection(x, z, centres, s)) for t, at, x, z, ret in times}

    def own(self, t: int) -> bool:
        return self.low <= t <= self.high

    def gated(self) -> dict[int, np.ndarray]:
        return {t: p.gated() for t, (_, _, p) in self.times.items() if self.own(t)}

    def weights(self, gated: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The weights of all the block's entities at each of its times."""
        self.wide = {}
        for t, (at, _, p) in self.times.items():
            self.wide[t] = np.zeros(self.n)
            self.wide[t][at] = p.trade(gated[t])
        self.none = np.zeros(self.n)
        self.mine = [t for t in range(self.low, self.high + 1) if t in gated]
        return self.wide

    def moves(self, t: int) -> np.ndarray:
        return self.wide.get(t, self.none) - self.wide.get(t - 1, self.none)

    def traded(self, gated: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Gross return, turnover and leverage of each time."""
        self.weights(gated)
        out = {}
        for t in self.mine:
            gross = self.wide[t][self.times[t][0]] @ self.times[t][1] if t in self.times else 0.0
            out[t] = np.array([gross, np.abs(self.moves(t)).sum(), np.abs(self.wide.get(t, self.none)).sum()])
        return out

    def ups(self, gated: dict[int, np.ndarray], traded: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Four derivatives by the weights at each time: of the net returns, of half their squares, of turnover,
        of half the squared excess leverage, those of the block's own times."""
        self.weights(gated)
        s, up = self.s, {t: np.zeros((4, self.n)) for t in self.times}
        for t in self.mine:
            side = np.sign(self.moves(t))
            net, excess = net_and_excess(traded[t], s)
            if t in up:
                ret = np.zeros(self.n)
                ret[self.times[t][0]] = self.times[t][1]
                up[t] += [ret - s.cost * side, net * (ret - s.cost * side), side, 2 * excess * np.sign(self.wide[t])]
            if t - 1 in up:
                up[t - 1][:3] += [s.cost * side, net * s.cost * side, -side]
        return {t: up[t][:, self.times[t][0]] for t in up}

    def by_consensus(self, gated: dict, traded: dict) -> dict[int, np.ndarray]:
        return {t: np.concatenate([self.times[t][2].by_consensus(u) for u in up]) for t, up in self.ups(gated, traded).items()}

    def slopes(self, gated: dict, traded: dict, consensus: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The four sums of derivatives by the normalised centres, at place 0."""
        out = 0.0
        for t, up in self.ups(gated, traded).items():
            through = consensus[t].reshape(4, -1) if self.own(t) else [None] * 4
            out = out + np.array([self.times[t][2].backward(u, c) for u, c in zip(up, through)])
        return {} if isinstance(out, float) else {0: out.ravel()}


def net_and_excess(traded: np.ndarray, s: Settings) -> tuple[float, float]:
    return traded[0] - s.cost * traded[1], max(traded[2] - s.most_leverage, 0.0)


def objective(sums: np.ndarray, centres: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Loss and its gradient by the (not normalised) centres, from the sums over all blocks."""
    net, square, turn, excess, n = sums[:5]
    slopes = sums[5:].reshape(4, *centres.shape)
    mean = net / n
    sd = np.sqrt(max((square - n * mean * mean) / max(n - 1, 1), 0.0))
    loss = -mean / (sd + 1e-6) + s.turnover_penalty * turn / n + s.leverage_penalty * excess / n
    # d mean / d net = 1 / n;  d sd / d net = (net - mean) / ((n - 1) sd)
    bend = mean / (max(n - 1, 1) * max(sd, 1e-300) * (sd + 1e-6) ** 2)
    by_net = -slopes[0] / (n * (sd + 1e-6)) + bend * (slopes[1] - mean * slopes[0])
    unit = by_net + s.turnover_penalty / n * slopes[2] + s.leverage_penalty / n * slopes[3]
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    w = centres / length
    return float(loss), (unit - w * (w * unit).sum(axis=1, keepdims=True)) / length


def time_blocks(rows: DataFrame, length: int, tables: Rounds, time: str = "t", entity: str = "i") -> DataFrame:
    """(low, high, entities, t and packed data): blocks of ``length`` times with the one before each, and of
    about ENTITIES entities, packed.  Rows (t int, i, x array, z, ret): the unit features, the last
    standardised value, and the return that follows; those of a time without returns are left out before."""
    block = F.floor(F.col(time) / length).cast("long")
    # A block needs the time before its first: rows of a block's last time go to the next one too.
    both = F.when(F.col(time) % length == length - 1, F.array(block, block + 1)).otherwise(F.array(block))
    widest = rows.groupBy(time).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(entity), F.lit(max(1, -(-widest // ENTITIES)))).alias("bucket")
    d = rows.select(F.explode(both).alias("block"), bucket, F.col(time).alias("t"), F.col(entity).alias("i"), "x", "z", "ret")

    def pack(key, pdf):
        ids = {x: k for k, x in enumerate(sorted(pdf["i"].unique()))}
        low, high = key[0] * length, (key[0] + 1) * length - 1
        out = []
        for t, g in pdf[(pdf["t"] >= low - 1) & (pdf["t"] <= high)].sort_values(["t", "i"]).groupby("t"):
            x = np.stack(g["x"].to_numpy()).astype("<f8")
            out.append((int(t), np.array([ids[i] for i in g["i"]], "<i4").tobytes(), g["z"].to_numpy("<f8").tobytes(), g["ret"].to_numpy("<f8").tobytes(), x.tobytes()))
        return pd.DataFrame({"low": [int(low)], "high": [int(high)], "entities": [len(ids)], **{c: [[o[k] for o in out]] for k, c in enumerate(("t", "at", "z", "ret", "x"))}})

    schema = "low long, high long, entities int, t array<int>, at array<binary>, z array<binary>, ret array<binary>, x array<binary>"
    return tables.cut(d.groupBy("block", "bucket").applyInPandas(pack, schema))


def _by_time(blocks: DataFrame, centres: np.ndarray, s: Settings, each) -> dict[int, np.ndarray]:
    """The sums by time of what ``each`` says of a block; a task adds up its own, a row a time reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            # A block at a time: packed ones are large.
            for row in range(b.num_rows):
                low, high, entities, *data = (b.column(c)[row].as_py() for c in ("low", "high", "entities", "t", "at", "x", "z", "ret"))
                times = [(t, np.frombuffer(at, "<i4"), np.frombuffer(x, "<f8").reshape(-1, centres.shape[1]), np.frombuffer(z, "<f8"), np.frombuffer(r, "<f8")) for t, at, x, z, r in zip(*data)]
                for t, part in each(Block(low, high, entities, times, centres, s)).items():
                    total[t] = total[t] + part if t in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["t", "sums"])

    parts = blocks.mapInArrow(run, "t long, sums array<double>").select("t", F.posexplode("sums").alias("at", "x"))
    found: dict[int, list[float]] = {}
    for r in parts.groupBy("t", "at").agg(F.sum("x").alias("x")).orderBy("t", "at").collect():  # a few numbers a time
        found.setdefault(r.t, []).append(r.x)
    return {t: np.array(x) for t, x in found.items()}


def sums_of(blocks: DataFrame, centres: np.ndarray, s: Settings) -> np.ndarray:
    """Sums over all times of net return, its square, turnover, squared excess leverage and one, then four
    derivatives by the normalised centres: of the net returns, of half their squares, of turnover, of the
    excess leverage."""
    w = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    gated = _by_time(blocks, w, s, lambda b: b.gated())
    traded = _by_time(blocks, w, s, lambda b: b.traded(gated))
    consensus = _by_time(blocks, w, s, lambda b: b.by_consensus(gated, traded))
    slopes = _by_time(blocks, w, s, lambda b: b.slopes(gated, traded, consensus))[0]
    sums = np.zeros(5)
    for t in sorted(traded):
        net, excess = net_and_excess(traded[t], s)
        sums += (net, net * net, traded[t][1], excess * excess, 1.0)
    return np.concatenate([sums, slopes])


def train_clusters(rows: DataFrame, clusters: int, epochs: int = 20, rate: float = 0.01, settings: Settings | None = None, block: int = 32, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """(cluster, centre, loss) of the centres of smallest loss, and the loss before each step.

    Rows (t int, i, x array<double>, z, ret), whole history in each step, by Adam.  The first centres are
    rows of the smallest hashes; an epoch is four jobs."""
    s, tables = settings or Settings(), Rounds(rows.sparkSession)
    whole = tables.cut(rows.where("z IS NOT NULL AND ret IS NOT NULL").select("t", "i", "x", "z", "ret"))
    drawn = whole.select(F.lit(0).alias("_one"), F.struct("t", "i").cast("string").alias("id"), F.col("x").alias("v"))
    first = window_models.first_centres(drawn, ["_one"], clusters, 1, seed).orderBy("cluster").collect()  # one row a cluster
    centres = np.array([r.centre for r in first])
    blocks = time_blocks(whole, block, tables)
    losses, best, m, v = [], (np.inf, centres), np.zeros_like(centres), np.zeros_like(centres)
    for step in range(1, epochs + 2):
        loss, slope = objective(sums_of(blocks, centres, s), centres, s)
        losses.append(loss)
        if loss < best[0]:
            best = loss, centres
        if step <= epochs:
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            centres = centres - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = [(k, [float(x) for x in c], float(best[0])) for k, c in enumerate(best[1])]
    return rows.sparkSession.createDataFrame(model, "cluster int, centre array<double>, loss double"), losses
