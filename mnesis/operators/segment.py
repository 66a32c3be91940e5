"""Sequential episode operators: greedy segmentation, merging, splitting, reassignment, consolidation."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.scores import temporal_decay
from mnesis.functions.sets import precision_overlap, tidy_entities
from mnesis.functions.vectors import cosine, mean_vector
from mnesis.operators import ordered
from mnesis.operators.components import connected_components
from mnesis.shared import materialise


@dataclass(frozen=True)
class SegmentConfig:
    semantic: float = 0.55
    entity: float = 0.15
    temporal: float = 0.10
    goal: float = 0.20
    age: float = 0.05
    threshold: float = 0.30
    time_minutes: float = 120.0
    recent_minutes: float = 480.0
    dormancy_minutes: float = 1440.0
    hard_break_minutes: float | None = None
    reactivate: bool = True  # whether dormant episodes can take rows again
    dual: bool = False  # compare with the founder's vector too
    ema: float = 0.80
    active_hours: float = 24.0
    novelty: float = 0.0
    novelty_episodes: int = 15
    boundary_gate: float | None = None  # attach without scoring below this boundary probability
    boundary_k: float = 0.3

    def pieces_minutes(self) -> float | None:
        """A gap beyond which rows without entities can't reach back, so that a stream may be cut there; None if there is none."""
        if self.boundary_gate is not None or self.novelty > 0:
            return None
        return min(self.recent_minutes, self.hard_break_minutes or math.inf)


class _Vectors:
    """One vector per episode, with its norm, in a matrix that grows."""

    def __init__(self):
        self.m, self.norm = None, None

    def get(self, no: int) -> np.ndarray | None:
        return self.m[no] if self.m is not None and no < len(self.norm) and self.norm[no] > 0 else None

    def put(self, no: int, v: np.ndarray) -> None:
        if self.m is None:
            self.m, self.norm = np.zeros((64, len(v))), np.zeros(64)
        while no >= len(self.norm):
            self.m, self.norm = np.vstack((self.m, np.zeros_like(self.m))), np.concatenate((self.norm, np.zeros_like(self.norm)))
        self.m[no], self.norm[no] = v, np.linalg.norm(v)

    def similarity(self, v: np.ndarray | None, at: np.ndarray) -> np.ndarray:
        """Cosine of ``v`` and the vectors of ``at``, 0 where there is none and below 0."""
        out = np.zeros(len(at))
        if v is None or self.m is None or not (n := np.linalg.norm(v)):
            return out
        ok = (at < len(self.norm)) & (self.norm[np.minimum(at, len(self.norm) - 1)] > 0)
        out[ok] = self.m[at[ok]] @ v / (self.norm[at[ok]] * n)
        return np.maximum(out, 0.0)


class _Episodes:
    """Episodes of one stream, in the order of their start.

    Candidates for a row are the episodes that ended within the recent window and all that share
    an entity with it, however old; an index of entities finds the latter. An episode idle for
    longer than the dormancy is dormant until a row is attached. The break is tested on the best
    candidate only: where that one is too old the row starts an episode, even if a second-best is fresh.
    """

    def __init__(self, cfg: SegmentConfig):
        self.cfg, self.ends, self.weights, self.current = cfg, [], [], None
        self.latest: OrderedDict[int, None] = OrderedDict()  # by end
        self.by_entity: dict[str, set[int]] = {}
        self.centroid, self.first, self.goal = _Vectors(), _Vectors(), _Vectors()
        self.reactivated = 0

    def _candidates(self, us: int, entities: list[str]) -> np.ndarray:
        found = set()
        for no in reversed(self.latest):
            if self.ends[no] < us - self.cfg.recent_minutes * 60e6:
                break
            found.add(no)
        for k in entities:
            found |= self.by_entity.get(k, set())
        if not self.cfg.reactivate:
            found = {n for n in found if not self._dormant(n, us)}
        return np.array(sorted(found), dtype=np.int64)

    def _dormant(self, no: int, us: int) -> bool:
        return us - self.ends[no] > self.cfg.dormancy_minutes * 60e6

    def add(self, us: int, vec: np.ndarray | None, entities: list[str], boundary: float | None, goal: np.ndarray | None = None) -> int:
        cfg = self.cfg
        gated = cfg.boundary_gate is not None
        if gated and self.current is not None and boundary is not None and boundary < cfg.boundary_gate:
            return self._attach(self.current, us, vec, entities, goal)
        need = cfg.threshold
        if cfg.novelty > 0:
            active = 0
            for no in reversed(self.latest):
                if self._dormant(no, us):
                    break
                active += 1
            need -= cfg.novelty * min(active / cfg.novelty_episodes, 1.0)
        if gated:
            need += cfg.boundary_k * (1 - (boundary if boundary is not None else 1.0))
        at = self._candidates(us, entities)
        if len(at):
            gap = np.array([us - self.ends[n] for n in at]) / 60e6
            sem = self.centroid.similarity(vec, at)
            if cfg.dual:
                sem = np.maximum(sem, self.first.similarity(vec, at))
            own = set(entities)
            ent = np.array([sum(w[k] for k in own & w.keys()) / (len(own) * max(w.values())) if own and w else 0.0 for w in (self.weights[n] for n in at)])
            idle = np.maximum(gap / 60, 0)
            age = np.where(gap > cfg.dormancy_minutes, np.log1p(idle), 0.3 * np.log1p(np.maximum(idle - cfg.active_hours, 0)))
            score = cfg.semantic * sem + cfg.entity * ent + cfg.temporal * np.exp(-2.3 / cfg.time_minutes * np.abs(gap)) + cfg.goal * self.goal.similarity(goal, at) - cfg.age * age
            score = np.maximum(score, 0.0)
            best = int(np.flatnonzero(score >= score.max() - 1e-12)[0])  # among equals the older
            if score[best] >= need and not (cfg.hard_break_minutes and gap[best] > cfg.hard_break_minutes):
                return self._attach(int(at[best]), us, vec, entities, goal)
        no = len(self.ends)
        self.ends.append(us)
        self.weights.append({k: 1.0 for k in entities})
        for store, v in ((self.centroid, vec), (self.first, vec), (self.goal, goal)):
            if v is not None:
                store.put(no, v)
        for k in entities:
            self.by_entity.setdefault(k, set()).add(no)
        self.latest[no] = None
        self.current = no
        return no + 1

    def _attach(self, no: int, us: int, vec: np.ndarray | None, entities: list[str], goal: np.ndarray | None) -> int:
        self.reactivated += self._dormant(no, us)
        for store, v in ((self.centroid, vec), (self.goal, goal)):
            if v is not None:
                old = store.get(no)
                store.put(no, v if old is None else (1 - self.cfg.ema) * old + self.cfg.ema * v)
        if vec is not None and self.first.get(no) is None:
            self.first.put(no, vec)
        self.ends[no] = max(self.ends[no], us)
        w = self.weights[no]
        for k in entities:
            w[k] = w.get(k, 0.0) + 1.0
            self.by_entity.setdefault(k, set()).add(no)
        self.latest.move_to_end(no)
        self.current = no
        return no + 1


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    d = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / d if d > 1e-9 else 0.0


def segment(rows: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """``stream, session, id, us, episode_no``: greedy segmentation of each stream in time order.

    ``rows``: ``stream, id, us, vec array<float>, entities array<string>, boundary double`` and, if wanted,
    ``goal array<float>`` (all but the first three may be null). A stream is sequential: it flows through one task
    that holds its episodes. Only a stream without entities is cut, at gaps that no candidate
    outlasts, and its pieces are keys of their own, numbered by ``session`` (1 for a stream left
    whole). Ties of the score go to the older episode, equal times are ordered by id.
    """
    cfg = config or SegmentConfig()
    goal = F.col("goal") if "goal" in rows.columns else F.lit(None).cast("array<double>")
    rows = rows.withColumn("goal", goal)
    if cfg.pieces_minutes() is None:
        pieces = rows.withColumn("session", F.lit(1).cast("bigint"))
    else:
        x = ordered.previous(rows, "stream", "us", "id", {"_us": "us"})
        named = rows.where(F.size("entities") > 0).select("stream").distinct().withColumn("_named", F.lit(True))
        x = x.join(named, "stream", "left")
        cut = F.when((F.col("us") - F.col("_us") <= int(cfg.pieces_minutes() * 60e6)) | (F.col("_us").isNotNull() & F.col("_named").isNotNull()), 0).otherwise(1)
        pieces = ordered.running_sum(x, "stream", "us", "id", cut, "session")
    in_order = pieces.select("stream", "session", "id", "us", "vec", "entities", "boundary", "goal").repartition("stream", "session").sortWithinPartitions("stream", "session", "us", "id")
    stream_type, id_type = rows.schema["stream"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        array = lambda v: np.asarray(v, dtype=float) if v is not None else None
        for pdf in batches:
            out = []
            for stream, session, us, vec, entities, p, goal in zip(*(pdf[c] for c in ("stream", "session", "us", "vec", "entities", "boundary", "goal"))):
                if key != (stream, session):
                    key, state = (stream, session), _Episodes(cfg)
                out.append(state.add(int(us), array(vec), list(entities) if entities is not None else [], None if p is None or p != p else float(p), array(goal)))
            yield pdf[["stream", "session", "id", "us"]].assign(episode_no=np.array(out, dtype=np.int64))

    return in_order.mapInPandas(run, f"stream {stream_type}, session bigint, id {id_type}, us bigint, episode_no bigint")


def temporal_only(gap_threshold: float = 0.30, minutes: float = 120.0) -> SegmentConfig:
    """Time alone: equal to islands with a gap of -ln(threshold) * minutes / 2.3."""
    return replace(SegmentConfig(), semantic=0, entity=0, temporal=1.0, age=0, threshold=gap_threshold, time_minutes=minutes)


def merge_small(episodes: DataFrame, most: int = 3, least_cos: float = 0.60, gap_minutes: float = 60.0) -> DataFrame:
    """``stream, episode_no, merged_no``: small episodes joined to the one before, as a left fold to its fixpoint.

    ``episodes``: ``stream, episode_no, start_us, end_us, n, centroid``. Neighbours more than the gap
    apart never merge, so streams are cut there and folded piece by piece.
    """
    w = Window.partitionBy("stream").orderBy("start_us", "episode_no")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = episodes.withColumn("_cut", F.when(F.col("start_us") - reach <= int(gap_minutes * 60e6), 0).otherwise(1))
    x = x.withColumn("_piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_us", "episode_no"])
        items = [{"nos": [r.episode_no], "s": r.start_us, "e": r.end_us, "n": r.n, "c": np.asarray(r.centroid, dtype=float)} for r in pdf.itertuples()]
        changed = True
        while changed:
            changed, out = False, []
            for b in items:
                a = out[-1] if out else None
                if a is not None and b["n"] <= most and _cos(a["c"], b["c"]) >= least_cos and b["s"] - a["e"] <= gap_minutes * 60e6:
                    n = a["n"] + b["n"]
                    a["c"], a["n"], a["nos"], a["e"] = (a["n"] * a["c"] + b["n"] * b["c"]) / n, n, a["nos"] + b["nos"], max(a["e"], b["e"])
                    changed = True
                else:
                    out.append(b)
            items = out
        rows = [(pdf["stream"].iloc[0], no, i["nos"][0]) for i in items for no in i["nos"]]
        return pd.DataFrame(rows, columns=["stream", "episode_no", "merged_no"])

    t = episodes.schema
    return x.groupBy("stream", "_piece").applyInPandas(fold, f"stream {t['stream'].dataType.simpleString()}, episode_no {t['episode_no'].dataType.simpleString()}, merged_no {t['episode_no'].dataType.simpleString()}")


def average_linkage(x: np.ndarray, least: int, most: int) -> dict[int, np.ndarray]:
    """Labels of ``least`` to ``most`` clusters of the rows of ``x`` (unit length or zero) by average linkage over cosine distance.

    The mean distance of two clusters is 1 minus the dot product of their mean vectors, so vectors
    stand for the pairwise distances, exactly and in memory linear in the rows. Nearest neighbours
    are found block by block and all mutual ones merge at once: average linkage is reducible, so
    the order of such merges doesn't change the tree. Equal rows are one cluster from the start.
    Clusters are numbered by their first row.
    """
    unique, first, inverse, count = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    point, mean, size = rank[inverse.ravel()], unique[order].astype(float), count[order].astype(float)
    n = len(mean)
    alive, near, far, height = np.arange(n), np.full(n, -1), np.full(n, np.inf), np.zeros(n)
    merges: list[tuple[float, int, int]] = []
    stale = alive
    while len(alive) > 1:
        step = max(1, 4_000_000 // len(alive))
        for i in range(0, len(stale), step):
            rows = stale[i : i + step]
            d = 1 - mean[rows] @ mean[alive].T
            d[np.arange(len(rows)), np.searchsorted(alive, rows)] = np.inf
            at = d.argmin(axis=1)
            near[rows], far[rows] = alive[at], d[np.arange(len(rows)), at]
        mutual = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(mutual):  # ties that rounding breaks differently from both sides
            mutual = alive[far[alive].argmin()][None]
        gone = []
        for i in mutual:
            i, j = sorted((int(i), int(near[i])))
            height[i] = max(far[i], far[j], height[i], height[j])  # a merge never comes before those it needs
            merges.append((height[i], i, j))
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            size[i] += size[j]
            gone.append(j)
        touched = np.zeros(n, dtype=bool)
        touched[gone] = True
        alive = alive[~touched[alive]]
        touched[mutual], touched[near[mutual]] = True, True
        stale = alive[touched[alive] | touched[near[alive]]]
    merges.sort(key=lambda m: m[0])  # stable
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out, left = {}, n
    for _, i, j in [*merges, (np.inf, 0, 0)]:
        if least <= left <= most:
            out[left] = np.unique(np.array([root(v) for v in range(n)]), return_inverse=True)[1][point]
        i, j = sorted((root(i), root(j)))
        parent[j], left = i, left - 1
    return out


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette over cosine distance; sums of distances come from sums of vectors, in linear time."""
    k = labels.max() + 1
    if k < 2:
        return 0.0
    sizes, at = np.bincount(labels, minlength=k), np.arange(len(labels))
    total = np.stack([x[labels == c].sum(axis=0) for c in range(k)])
    sums = np.maximum(sizes - x @ total.T, 0)
    own = sizes[labels]
    a = np.where(own > 1, np.maximum(sums[at, labels] - (1 - (x * x).sum(axis=1)), 0) / np.maximum(own - 1, 1), 0)
    mean = sums / sizes
    mean[at, labels] = np.inf
    b = mean.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    return float(s.mean())


def split_large(members: DataFrame, least_size: int = 8, least_cluster: int = 3, least_score: float = 0.10) -> DataFrame:
    """``episode, id, part``: incoherent episodes split by average linkage with the best silhouette.

    ``members``: ``episode, id, us, vec``. Part 0 stands for an episode that stays whole. An episode of
    any size is clustered as a whole; a task holds its vectors, never its pairwise distances.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        ok = pdf["vec"].map(lambda v: v is not None)
        part = np.zeros(len(pdf), dtype=np.int64)
        if ok.sum() >= least_size:
            X = np.stack([np.asarray(v, dtype=float) for v in pdf["vec"][ok]])
            X = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-9)
            best = (least_score, None)
            for _, labels in sorted(average_linkage(X, 2, max(2, min(6, len(X) // 3))).items()):
                if np.bincount(labels).min() >= least_cluster and (s := silhouette(X, labels)) >= best[0]:
                    if best[1] is None or s > best[0]:
                        best = (s, labels)
            if best[1] is not None:
                part[np.flatnonzero(ok)] = best[1] + 1
        return pd.DataFrame({"episode": pdf["episode"], "id": pdf["id"], "part": part})

    t = members.schema
    return members.groupBy("episode").applyInPandas(run, f"episode {t['episode'].dataType.simpleString()}, id {t['id'].dataType.simpleString()}, part bigint")


def reassign(rows: DataFrame, membership: DataFrame, dimension: int, rounds: int = 3, window_minutes: float = 480.0, config: SegmentConfig | None = None) -> DataFrame:
    """``stream, id, episode``: artifacts moved to the episode nearby that fits best, a few rounds.

    ``rows``: ``stream, id, us, vec, entities``; ``membership``: ``stream, id, episode``. Candidates come
    from a time-binned equi-join on stream and bin. Members of episodes of two or fewer stay; on
    ties the current episode wins, then the smaller one. Each round is written to the shared folder.
    """
    cfg = config or SegmentConfig()
    bin_us = int(window_minutes * 60e6)
    rows = rows.withColumn("entities", tidy_entities(F.col("entities")))
    for _ in range(rounds):
        m = rows.join(membership, ["stream", "id"])
        stats = m.groupBy("stream", "episode").agg(F.min("us").alias("s"), F.max("us").alias("e"), F.count(F.lit(1)).alias("n"), mean_vector("vec", dimension).alias("centroid"))
        weights = (
            m.select("stream", "episode", F.explode("entities").alias("k")).groupBy("stream", "episode", "k").agg(F.count(F.lit(1)).cast("double").alias("w"))
            .groupBy("stream", "episode").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("weights"))
        )
        eps = stats.join(weights, ["stream", "episode"], "left")
        eps = eps.withColumn("bin", F.explode(F.sequence(F.floor((F.col("s") - bin_us) / bin_us), F.floor((F.col("e") + bin_us) / bin_us))))
        movable = m.join(stats.select("stream", "episode", F.col("n").alias("own_n")), ["stream", "episode"]).where("own_n > 2").withColumn("bin", F.floor(F.col("us") / bin_us))
        c = movable.select("stream", "id", "us", "vec", F.col("entities").alias("own"), F.col("episode").alias("now"), "bin").join(eps, ["stream", "bin"])
        c = c.where((F.col("e") >= F.col("us") - bin_us) & (F.col("s") <= F.col("us") + bin_us))
        sem = F.greatest(F.coalesce(cosine("vec", "centroid"), F.lit(0.0)), F.lit(0.0))
        gap = F.abs(F.col("us") - F.col("e")) / 60e6
        ent = F.coalesce(precision_overlap(F.col("own"), F.col("weights")), F.lit(0.0))
        score = cfg.semantic * sem + cfg.entity * ent + cfg.temporal * temporal_decay(gap, cfg.time_minutes)
        best = c.groupBy("stream", "id").agg(F.min_by("episode", F.struct((-F.round(score, 9)).alias("s"), (F.col("episode") != F.col("now")).alias("o"), F.col("episode").alias("e"))).alias("moved"))
        new = materialise(membership.join(best, ["stream", "id"], "left").select("stream", "id", F.coalesce("moved", "episode").alias("episode")), "membership")
        changed = new.withColumnRenamed("episode", "x").join(membership, ["stream", "id"]).where("x <> episode").limit(1).count()
        membership = new
        if not changed:
            break
    return membership


def consolidation_pairs(episodes: DataFrame, edges: DataFrame, least_cos: float = 0.70, least_jaccard: float = 0.30, gap_hours: float = 72.0) -> DataFrame:
    """``a, b, score``, a < b: all pairs of the given (dormant) episodes that qualify for consolidation.

    ``episodes``: ``episode, start_us, end_us, centroid``; ``edges``: ``episode, entity``. Sets of Jaccard t
    share an entity among the n - ceil(t n) + 1 rarest of each side, and the end of one episode lies
    within the gap of the start of the other: the equi-join on rare entity and time bin loses no
    pair, and never emits all pairs of a popular entity.
    """
    if least_jaccard <= 0:
        raise ValueError("episodes without a shared entity can't be found through entities")
    gap_us = int(gap_hours * 3.6e9)
    usable = episodes.where("start_us is not null and end_us is not null and centroid is not null")
    e = edges.select("episode", "entity").distinct().join(usable.select("episode", "start_us", "end_us"), "episode")
    e = materialise(e.join(e.groupBy("entity").agg(F.count(F.lit(1)).alias("df")), "entity"), "entities")
    own = Window.partitionBy("episode")
    x = e.withColumns({"_rn": F.row_number().over(own.orderBy("df", "entity")), "_n": F.count(F.lit(1)).over(own)})
    x = x.where(F.col("_rn") <= F.col("_n") - F.ceil(least_jaccard * F.col("_n") - 1e-9) + 1)
    at = lambda c: F.floor(F.col(c) / max(gap_us, 1))
    ends = x.select(F.col("episode").alias("x"), "entity", "end_us", F.explode(F.sequence(at("end_us") - 1, at("end_us") + 1)).alias("bin"))
    starts = x.select(F.col("episode").alias("y"), "entity", "start_us", at("start_us").alias("bin"))
    near = ends.join(starts, ["entity", "bin"]).where((F.col("x") != F.col("y")) & (F.abs(F.col("start_us") - F.col("end_us")) <= gap_us))
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sets = e.groupBy("episode").agg(F.collect_set("entity").alias("k"))
    with_both = lambda p, v, n: p.join(v.select(F.col("episode").alias("a"), F.col(n).alias(f"{n}_a")), "a").join(v.select(F.col("episode").alias("b"), F.col(n).alias(f"{n}_b")), "b")
    alike = with_both(near, sets, "k")
    shared = F.size(F.array_intersect("k_a", "k_b"))
    alike = alike.select("a", "b", (shared / (F.size("k_a") + F.size("k_b") - shared)).alias("jac")).where(F.col("jac") >= least_jaccard)
    alike = with_both(alike, usable, "centroid")
    sim = cosine("centroid_a", "centroid_b")
    return alike.where(sim >= least_cos).select("a", "b", F.round(sim + F.col("jac"), 6).alias("score"))


def consolidate(episodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``episode, base``: the episodes that qualifying pairs link, directly or through others, and the largest of each group.

    ``episodes``: ``episode, n, start_us``. Of equally large episodes the older is the base.
    """
    group = materialise(connected_components(pairs).withColumnRenamed("node", "episode"), "groups")
    base = group.join(episodes, "episode").groupBy("component").agg(F.min_by("episode", F.struct(-F.coalesce("n", F.lit(-1)), "start_us", "episode")).alias("base"))
    return group.join(base, "component").select("episode", "base")


def split_candidates(members: DataFrame, dimension: int, least_size: int = 8, least_cohesion: float = 0.55, span_hours: float = 168.0) -> DataFrame:
    """``episode``: those of enough members that are incoherent or span too long. ``members``: ``episode, id, us, vec``."""
    stats = members.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("span_us"), mean_vector("vec", dimension).alias("centroid"))
    cohesion = members.join(stats.where(F.col("n") >= least_size), "episode").groupBy("episode").agg(F.avg(cosine("vec", "centroid")).alias("cohesion"), F.max("span_us").alias("span_us"))
    return cohesion.where((F.col("cohesion") < least_cohesion) | (F.col("span_us") > int(span_hours * 3.6e9))).select("episode")
