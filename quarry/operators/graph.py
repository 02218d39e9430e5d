"""Property-graph operators as joins over edge tables; loops cut their lineage every round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.core.components import connected_components
from quarry.core.runtime import cut
from quarry.operators.aggregates import over_full_groups

# Relation -> domain labels, range labels, symmetric.
ONTOLOGY = {
    "SUBSIDIARY_OF": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY"}, False),
    "PARENT_OF": ({"COMPANY"}, {"COMPANY", "SUBSIDIARY"}, False),
    "SUPPLIES_TO": ({"COMPANY", "SUBSIDIARY", "SUPPLIER"}, {"COMPANY", "CUSTOMER"}, False),
    "CUSTOMER_OF": ({"COMPANY", "CUSTOMER"}, {"COMPANY", "SUPPLIER"}, False),
    "SOLE_SOURCE_DEPENDENT_ON": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY", "SUPPLIER"}, False),
    "COMPETES_WITH": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, True),
    "PARTNERED_WITH": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, True),
    "CEO_OF": ({"PERSON", "EXECUTIVE"}, {"COMPANY", "SUBSIDIARY"}, False),
    "EXECUTIVE_OF": ({"PERSON", "EXECUTIVE"}, {"COMPANY", "SUBSIDIARY"}, False),
    "DIRECTOR_OF": ({"PERSON", "EXECUTIVE"}, {"COMPANY", "SUBSIDIARY"}, False),
    "INSIDER_OF": ({"PERSON", "EXECUTIVE"}, {"COMPANY", "SUBSIDIARY"}, False),
    "EXPOSED_TO_RISK": ({"COMPANY", "SUBSIDIARY"}, {"GEOPOLITICALRISK", "COMMODITY", "REGULATORYBODY", "MARKETEVENT", "RISK", "METRIC"}, False),
    "LICENSES_FROM": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, False),
    "LICENSES_TO": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, False),
    "ACQUIRED_BY": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY"}, False),
    "DEFAULTED_ON": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "FINANCIALINSTITUTION"}, False),
    "SPUN_OFF_FROM": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, False),
    "OWNS": ({"COMPANY", "SUBSIDIARY", "FINANCIALINSTITUTION", "PERSON"}, {"COMPANY", "SUBSIDIARY"}, False),
    "INVESTS_IN": ({"COMPANY", "SUBSIDIARY", "FINANCIALINSTITUTION", "PERSON"}, {"COMPANY", "SUBSIDIARY", "SECTOR", "INDUSTRY", "TECHNOLOGY", "PRODUCT"}, False),
    "PRODUCES": ({"COMPANY", "SUBSIDIARY"}, {"PRODUCT", "TECHNOLOGY", "COMMODITY"}, False),
    "IMPACTS": ({"MARKETEVENT", "GEOPOLITICALRISK", "RISK", "REGULATORYBODY", "SECTOR", "COMPANY", "METRIC", "PRODUCT"}, {"COMPANY", "SUBSIDIARY", "SECTOR", "PRODUCT", "METRIC"}, False),
    "REPORTS": ({"COMPANY", "SUBSIDIARY"}, {"METRIC", "RISK", "FORM", "FILING"}, False),
    "FILED": ({"COMPANY", "SUBSIDIARY"}, {"FORM", "FILING", "DOCUMENT"}, False),
    "CO_INVESTS_WITH": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, True),
    "PEER_OF": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, True),
    "COLLABORATES_WITH": ({"COMPANY", "SUBSIDIARY"}, {"COMPANY", "SUBSIDIARY"}, True),
}
LABELS = {
    "RISKFACTOR": "RISK", "RISK_FACTOR": "RISK", "GEOPOLITICAL_RISK": "GEOPOLITICALRISK", "REGULATORY_BODY": "REGULATORYBODY",
    "MARKET_EVENT": "MARKETEVENT", "FINANCIAL_INSTITUTION": "FINANCIALINSTITUTION", "FINANCIALMETRIC": "METRIC", "FINANCIAL_METRIC": "METRIC",
}
ALIASES = {
    "ACQUIRED": ("ACQUIRED_BY", True), "HAS_SUBSIDIARY": ("SUBSIDIARY_OF", True), "SUPPLIED_BY": ("SUPPLIES_TO", True), "LEADS": ("EXECUTIVE_OF", False),
    "CONTROLS": ("OWNS", False), "MERGED_WITH": ("PARTNERED_WITH", False), "FILED_FORM": ("FILED", False), "EXPOSED_TO": ("EXPOSED_TO_RISK", False),
}


def k_hop(edges: DataFrame, roots: DataFrame, hops: int, src: str = "source", dst: str = "target") -> DataFrame:
    """Edges met within ``hops`` of the roots, each once with its hop (from 1).

    ``edges`` are filtered before the call, so a filter prunes the walk.  A node is visited
    once; nodes of the last hop are not expanded.  ``roots`` has one column, the node.
    """
    seen = cut(roots.select(F.col(roots.columns[0]).alias("node")).where("node is not null").distinct())
    frontier, out = seen, None
    for hop in range(1, hops + 1):
        step = cut(edges.join(frontier.withColumnRenamed("node", src), src, "left_semi").withColumn("hop", F.lit(hop)))
        out = step if out is None else out.unionByName(step)
        if hop == hops:
            break
        frontier = cut(step.select(F.col(dst).alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def ego(edges: DataFrame, roots: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` around the roots in both directions: least hop and role of each node."""
    down = k_hop(edges, roots, hops)
    flip = edges.withColumnRenamed("source", "_t").withColumnRenamed("target", "source").withColumnRenamed("_t", "target")
    up = k_hop(flip, roots, hops)
    up = up.withColumnRenamed("source", "_t").withColumnRenamed("target", "source").withColumnRenamed("_t", "target")
    root = roots.select(F.col(roots.columns[0]).alias("node")).distinct()
    parts = [root.select("node", F.lit(0).alias("hop"), F.lit("ROOT").alias("role"))]
    parts += [down.select(F.col("target").alias("node"), "hop", F.lit("DOWNSTREAM").alias("role")), up.select(F.col("source").alias("node"), "hop", F.lit("UPSTREAM").alias("role"))]
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    roles = F.collect_set("role")
    role = F.when(F.array_contains(roles, "ROOT"), "ROOT").when(F.size(roles) > 1, "BOTH").otherwise(F.element_at(roles, 1))
    nodes = allp.groupBy("node").agg(F.min("hop").alias("hop"), role.alias("role"))
    keys = [c for c in edges.columns]
    return nodes, down.unionByName(up.select(down.columns)).groupBy(*keys).agg(F.min("hop").alias("hop"))


def hop_distances(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, dist)`` of every node reachable from the seeds, within ``most`` hops if given."""
    e = edges.select("source", "target").distinct()
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("dist")).distinct())
    frontier = seen
    for d in itertools.count(1) if most is None else range(1, most + 1):
        nxt = e.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = cut(nxt.join(seen, "node", "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Counted edges up to which a graph is worked through in one task (some hundred MB); the rounds beyond give the same.
SMALL_GRAPH = 1_000_000


def strong_components(edges: DataFrame, most: int = 50, small: int = SMALL_GRAPH) -> DataFrame:
    """``(node, scc)`` of nodes on a cycle (self-loops too); scc = smallest node.

    Up to ``small`` counted edges one task does it.  Beyond, nodes without way in or out are
    trimmed; the rest is coloured by the least node that reaches them, and a colour's
    component is what reaches back its least node.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u is not null and v is not null").distinct())
    loops = cut(e.where("u = v").select(F.col("u").alias("node")))
    e = cut(e.where("u <> v"))
    if e.limit(small + 1).count() <= small:
        found = cut(e.repartition(1).mapInPandas(_in_one_task, "node string, scc string"))
        return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("scc")))
    out = spark.createDataFrame([], "node string, scc string")
    for rounds in range(most + 1):
        while True:
            n = e.count()
            t = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
            e = cut(t.join(t.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
            if e.count() == n:
                break
        if n == 0:
            break
        if rounds == most:
            raise RuntimeError("strong components did not settle within most rounds")
        color = cut(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("c", F.col("node")))
        while True:
            low = e.join(color.select(F.col("node").alias("u"), "c"), "u").groupBy(F.col("v").alias("node")).agg(F.min("c").alias("d"))
            new = cut(color.join(low, "node", "left").select("node", F.least("c", F.coalesce("d", "c")).alias("c")))
            moved = new.join(color.withColumnRenamed("c", "old"), "node").where("c <> old").limit(1).count()
            color = new
            if not moved:
                break
        cu, cv = color.select(F.col("node").alias("u"), F.col("c").alias("cu")), color.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        same = cut(e.join(cu, "u").join(cv, "v").where("cu = cv").select("u", "v", F.col("cu").alias("c")))
        back = cut(color.where("node = c"))
        while True:
            more = same.join(back.select(F.col("node").alias("v"), "c"), ["v", "c"], "left_semi").select(F.col("u").alias("node"), "c").distinct()
            more = cut(more.join(back, ["node", "c"], "left_anti"))
            if more.isEmpty():
                break
            back = cut(back.unionByName(more))
        sized = back.withColumn("k", F.count("*").over(W.partitionBy("c"))).where("k > 1")
        out = cut(out.unionByName(sized.select("node", F.col("c").alias("scc"))))
        done = back.select("node")
        e = cut(e.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti"))
    return out.unionByName(loops.join(out, "node", "left_anti").select("node", F.col("node").alias("scc")))


def _in_one_task(frames):
    """Strong components of two or more nodes, by finishing order forwards and a walk backwards."""
    import pandas as pd

    ahead: dict = {}
    back: dict = {}
    for x in frames:
        for u, v in zip(x["u"], x["v"]):
            ahead.setdefault(u, []).append(v)
            back.setdefault(v, []).append(u)
    finished, seen = [], set()
    for root in sorted(ahead):
        if root in seen:
            continue
        seen.add(root)
        path = [(root, iter(ahead[root]))]
        while path:
            node, rest = path[-1]
            step = next((y for y in rest if y not in seen), None)
            if step is None:
                finished.append(node)
                path.pop()
            else:
                seen.add(step)
                path.append((step, iter(ahead.get(step, ()))))
    nodes, names, taken = [], [], set()
    for root in reversed(finished):
        if root in taken:
            continue
        taken.add(root)
        group, todo = [], [root]
        while todo:
            node = todo.pop()
            group.append(node)
            more = [y for y in back.get(node, ()) if y not in taken]
            taken.update(more)
            todo += dict.fromkeys(more)
        if len(group) > 1:
            nodes += group
            names += [min(group)] * len(group)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "scc": pd.Series(names, dtype=object)})


def feedback_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges within one strong component that do not lead away from the seeds (unreached counts as endless)."""
    scc, dist = strong_components(edges), hop_distances(edges, seeds)
    far = F.lit(2**31 - 1)
    x = edges.join(scc.select(F.col("node").alias("source"), F.col("scc").alias("_a")), "source").join(scc.select(F.col("node").alias("target"), F.col("scc").alias("_b")), "target").where("_a = _b")
    x = x.join(dist.select(F.col("node").alias("source"), F.col("dist").alias("_du")), "source", "left").join(dist.select(F.col("node").alias("target"), F.col("dist").alias("_dv")), "target", "left")
    return x.where(F.coalesce("_dv", far) <= F.coalesce("_du", far)).select(edges.columns)


def spectral_radius(edges: DataFrame, share: str = "share", largest: int = 2000) -> float:
    """Largest absolute eigenvalue of the weighted adjacency; 0.0 for a graph without cycles.

    Only strong components matter.  Each is solved exactly up to ``largest`` nodes, and by
    distributed power iteration beyond.  Shares are not negative.
    """
    import numpy as np

    scc = cut(strong_components(edges))
    if scc.isEmpty():
        return 0.0
    a, b = scc.select(F.col("node").alias("source"), "scc"), scc.select(F.col("node").alias("target"), F.col("scc").alias("_s"))
    inner = cut(edges.join(a, "source").join(b, "target").where("scc = _s").groupBy("scc", "source", "target").agg(F.sum(share).alias("w")))
    sizes = scc.groupBy("scc").agg(F.count("*").alias("n"))
    big = [_perron(inner.where(F.col("scc") == r[0])) for r in sizes.where(F.col("n") > largest).select("scc").toLocalIterator()]  # few: each is large

    def radius(pdf):
        nodes = {x: i for i, x in enumerate(sorted(set(pdf.source) | set(pdf.target)))}
        m = np.zeros((len(nodes), len(nodes)))
        for s, t, w in zip(pdf.source, pdf.target, pdf.w):
            m[nodes[t], nodes[s]] += w
        return type(pdf)({"rho": [float(np.abs(np.linalg.eigvals(m)).max())]})

    small = inner.join(sizes.where(F.col("n") <= largest), "scc", "left_semi").groupBy("scc").applyInPandas(radius, "rho double").agg(F.max("rho")).first()[0]
    return float(max([small or 0.0, *big]))


def _perron(inner: DataFrame, tolerance: float = 1e-6, most: int = 500) -> float:
    """Radius of one strong component by power iteration on the matrix plus a multiple of the identity.

    The shift makes the matrix primitive, and the least and largest growth of a positive
    vector enclose the radius (Collatz and Wielandt), so the tolerance holds for the result.
    """
    e = cut(inner.select("source", "target", "w"))
    if e.where("w < 0").limit(1).count():
        raise ValueError("shares of a large component must not be negative")
    e = e.where("w > 0")
    shift = e.groupBy("source").agg(F.sum("w").alias("w")).agg(F.avg("w")).first()[0]
    if shift is None:
        return 0.0
    x = cut(e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(most):
        y = e.join(x.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        y = cut(x.join(y, "node", "left").select("node", "x", (F.coalesce("y", F.lit(0.0)) + F.lit(shift) * F.col("x")).alias("y")))
        low, high, top = y.agg(F.min(F.col("y") / F.col("x")), F.max(F.col("y") / F.col("x")), F.max("y")).first()
        if high - low <= tolerance * max(high - shift, shift):
            return (low + high) / 2 - shift
        x = y.select("node", (F.col("y") / F.lit(top)).alias("x"))
    raise RuntimeError("the spectral radius did not settle within most rounds")


def cascade(edges: DataFrame, shocks: DataFrame, rounds: int = 5, gamma: float = 0.5, tolerance: float = 1e-9, floor: float = 0.05, threshold_pct: float = 25.0, acyclic: bool = False, small: int = SMALL_GRAPH) -> DataFrame:
    """Shock propagation: one row per node of the graph.

    Up to ``small`` counted edges and shocks one task does it on arrays, beyond it runs in
    rounds of joins; both give the same.

    ``edges``: ``(source, target, input_group, share, buffer_days)``; ``shocks``:
    ``(node, shock, duration, onset)``, shocks above 1 are percent.  Rounds read the state of
    the round before: shares of one input group add up to at most 1, the worst group counts,
    an edge with buffer needs shock times duration beyond it, feedback edges are damped.  A
    second pass by hop sets onset and duration.  Nodes of one hop read each other's state of
    the hop before.  Null durations and onsets count 0; seeds outside the graph have no row.
    Shares of a group that add up to more than 1 are an error.
    """
    if over_full_groups(edges, "target", "input_group", "share").limit(1).count():
        raise ValueError("the shares of an input group add up to more than 1")
    e = cut(edges.select("source", "target", "input_group", F.col("share").cast("double").alias("share"), F.coalesce(F.col("buffer_days").cast("double"), F.lit(0.0)).alias("buffer_days")))
    every = e.unionByName(shocks.select(F.col("node").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("input_group"), F.col("shock").cast("double").alias("share"), F.lit(0.0).alias("buffer_days"), F.col("duration").cast("double").alias("duration"), F.col("onset").cast("double").alias("onset")), allowMissingColumns=True)
    if every.limit(small + 1).count() <= small:
        kind = "node string, h double, t double, d double, beyond boolean, friction boolean"
        return _summary(every.repartition(1).mapInPandas(_cascade_of(rounds, gamma, tolerance, floor, acyclic), kind), threshold_pct)
    value = F.when(F.col("shock") > 1, F.col("shock") / 100).otherwise(F.col("shock"))
    s = shocks.groupBy("node").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("h0"), F.max(F.coalesce("duration", F.lit(0.0))).alias("d0"), F.max(F.coalesce("onset", F.lit(0.0))).alias("t0"))
    seeds = s.where("h0 > 0").select("node")
    dist = hop_distances(e, seeds)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    state = nodes.join(s, "node", "left").join(dist, "node", "left")
    state = cut(state.select("node", F.coalesce("h0", F.lit(0.0)).alias("h0"), F.coalesce("d0", F.lit(0.0)).alias("d0"), F.coalesce("t0", F.lit(0.0)).alias("t0"), "dist"))
    damp = None
    if not acyclic:
        damp = cut(feedback_edges(e, seeds).select("source", "target", "input_group", F.lit(gamma).alias("g")).distinct())
    w = e if damp is None else e.join(damp, ["source", "target", "input_group"], "left").withColumn("share", F.col("share") * F.coalesce("g", F.lit(1.0))).drop("g")
    w = cut(w)
    h = state.select("node", F.col("h0").alias("h"), F.col("d0").alias("d"))
    live = (F.col("h") > 0) & ((F.col("buffer_days") <= 0) | (F.col("h") * F.col("d") > F.col("buffer_days")))
    for _ in range(rounds):
        carried = w.join(h.withColumnRenamed("node", "source"), "source").where(live)
        groups = carried.groupBy("target", "input_group").agg(F.least(F.lit(1.0), F.sum(F.col("share") * F.col("h"))).alias("x"))
        hit = groups.groupBy(F.col("target").alias("node")).agg(F.max("x").alias("x"))
        new = cut(state.join(hit, "node", "left").join(h.withColumnRenamed("h", "old"), "node").select("node", F.greatest("h0", F.coalesce("x", F.lit(0.0))).alias("h"), "d", "old"))
        change = new.agg(F.max(F.abs(F.col("h") - F.col("old")))).first()[0] or 0.0
        h = new.select("node", "h", "d")
        if change < tolerance:
            break
    seed = F.col("h0") > 0
    timing = cut(state.join(h.select("node", "h"), "node").select("node", "h", "h0", "dist", "d0", F.when(seed, F.col("t0")).alias("t0")))
    # Beyond one hop after the last round nothing arrives: those nodes have neither onset nor downtime.
    done = timing.where(F.coalesce("dist", F.lit(2**31 - 1)) > rounds + 1).select("node", F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("d"))
    for level in range(rounds + 2):
        # nodes of later hops, and of this one, still have what they started with
        now = timing.join(done, "node", "left").select("node", "h", F.when(F.col("d").isNull(), F.col("t0")).otherwise(F.col("t")).alias("t"), F.coalesce("d", "d0").alias("d"))
        dst = timing.where(F.col("dist") == level).select("node", "h0", "d0", "t0")
        x = w.join(dst.select(F.col("node").alias("target")), "target", "left_semi").join(now.withColumnRenamed("node", "source"), "source").where(live)
        lag = F.col("buffer_days") / F.col("h")
        x = x.select("target", (F.coalesce("t", F.lit(0.0)) + lag).alias("a"), F.greatest(F.lit(0.0), F.col("d") - lag).alias("b")).where("b > 0")
        x = x.groupBy(F.col("target").alias("node")).agg(F.min("a").alias("na"), F.max(F.col("a") + F.col("b")).alias("nb"))
        keeps = (F.col("h0") > 0) & (F.col("d0") > 0)
        t = F.when(F.col("na").isNotNull(), F.col("na")).when(keeps, F.col("t0"))
        d = F.when(F.col("na").isNotNull(), F.greatest(F.lit(0.0), F.col("nb") - F.col("na"))).when(keeps, F.col("d0")).otherwise(0.0)
        done = done.unionByName(cut(dst.join(x, "node", "left").select("node", t.alias("t"), d.alias("d"))))
    timing = cut(timing.join(done, "node").select("node", "h", "h0", "dist", "t", "d"))
    held = e.where("buffer_days > 0").join(timing.select(F.col("node").alias("source"), "h", "d"), "source").where("h > 0 and h * d <= buffer_days").select(F.col("target").alias("node"), F.lit(True).alias("held")).distinct()
    r = timing.join(held, "node", "left").withColumn("friction", F.coalesce("held", F.lit(False)) & (F.col("d") == 0) & ~seed)
    r = r.withColumn("h", F.when(F.col("friction"), F.greatest("h", F.lit(floor))).otherwise(F.col("h")))
    return _summary(r.withColumn("beyond", F.coalesce("dist", F.lit(2**31 - 1)) > rounds), threshold_pct)


def _summary(r: DataFrame, threshold_pct: float) -> DataFrame:
    r = r.withColumn("peak", F.round(F.col("h") * 100, 4))
    verdict = F.when(F.col("peak") >= threshold_pct, "DISRUPTIVE_SHOCK").when(F.col("friction"), "TOLERATED_BUFFERED").when(F.col("peak") > 0, "CONTAINED_MINIMAL_CONTAGION").otherwise("NEUTRAL_UNAFFECTED")
    return r.select(
        F.col("node").alias("target_entity"), F.col("peak").alias("peak_shock_pct"), F.round("h", 6).alias("impairment_score"), F.col("t").alias("onset_day"), F.col("d").alias("downtime_days"),
        F.round(F.col("h") * F.col("d"), 4).alias("lost_capacity_days"), F.col("beyond").alias("is_out_of_horizon"), F.col("friction").alias("is_friction_floor"), verdict.alias("verdict"),
    )


def _cascade_of(rounds: int, gamma: float, tolerance: float, floor: float, acyclic: bool):
    """The cascade of a graph that fits into one task; rows without a target are shocks."""
    import numpy as np
    import pandas as pd

    def run(frames):
        x = pd.concat(list(frames))
        e, s = x[x["target"].notna()], x[x["target"].isna()]
        if not len(e):
            return
        names, ends = np.unique(np.concatenate([e["source"], e["target"]]).astype(str), return_inverse=True)
        src, dst = ends[: len(e)], ends[len(e) :]
        share, buffer = e["share"].to_numpy(float), e["buffer_days"].to_numpy(float)
        group = pd.factorize(pd.Series(dst).astype(str) + "\x00" + e["input_group"].fillna("\x01").astype(str).to_numpy())[0]
        owner = np.zeros(group.max() + 1, np.int64)
        owner[group] = dst
        n, place = len(names), {v: i for i, v in enumerate(names)}
        h0, d0, t0 = np.zeros(n), np.zeros(n), np.zeros(n)
        for who, shock, duration, onset in zip(s["source"], s["share"], s["duration"].fillna(0.0), s["onset"].fillna(0.0)):
            i = place.get(who)
            if i is not None and shock == shock:
                h0[i] = max(h0[i], min(1.0, max(0.0, shock / 100 if shock > 1 else shock)))
            if i is not None:
                d0[i], t0[i] = max(d0[i], duration), max(t0[i], onset)
        seed, far = h0 > 0, 2**31 - 1
        dist, step = np.where(seed, 0, far), 0
        while (dist == step).any():
            dist[dst[(dist[src] == step) & (dist[dst] == far)]] = step + 1
            step += 1
        if not acyclic:
            parts = next(_in_one_task([pd.DataFrame({"u": names[src[src != dst]], "v": names[dst[src != dst]]})]))
            scc = np.arange(n) + n
            for node, name in zip(parts["node"], parts["scc"]):
                scc[place[node]] = place[name]
            share = np.where((scc[src] == scc[dst]) & (dist[dst] <= dist[src]), gamma * share, share)

        def live(h, d):
            return (h[src] > 0) & ((buffer <= 0) | (h[src] * d[src] > buffer))

        h = h0.copy()
        for _ in range(rounds):
            sums = np.minimum(1.0, np.bincount(group, np.where(live(h, d0), share * h[src], 0.0)))
            new = h0.copy()
            np.maximum.at(new, owner, sums)
            change, h = np.abs(new - h).max(), new
            if change < tolerance:
                break
        d, t = d0.copy(), np.where(seed, t0, np.nan)
        d[dist > rounds + 1], t[dist > rounds + 1] = 0.0, np.nan
        # nodes far away count as untouched until the last level is done
        then_d, then_t = d0.copy(), np.where(seed, t0, np.nan)
        for level in range(rounds + 2):
            lag = np.divide(buffer, h[src], out=np.zeros(len(src)), where=h[src] > 0)
            begin, length = np.nan_to_num(then_t[src]) + lag, np.maximum(0.0, then_d[src] - lag)
            hit = live(h, then_d) & (length > 0) & (dist[dst] == level)
            first, last = np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(first, dst[hit], begin[hit])
            np.maximum.at(last, dst[hit], (begin + length)[hit])
            here, some, keeps = dist == level, np.isfinite(first), seed & (d0 > 0)
            t[here] = np.where(some, first, np.where(keeps, t0, np.nan))[here]
            d[here] = np.where(some, np.maximum(0.0, last - np.where(some, first, 0.0)), np.where(keeps, d0, 0.0))[here]
            then_t[here], then_d[here] = t[here], d[here]
        held = np.zeros(n, bool)
        held[dst[(buffer > 0) & (h[src] > 0) & (h[src] * d[src] <= buffer)]] = True
        friction = held & (d == 0) & ~seed
        h = np.where(friction, np.maximum(h, floor), h)
        onset = pd.Series(t, dtype=object).where(~np.isnan(t), None)
        yield pd.DataFrame({"node": names, "h": h, "t": onset, "d": d, "beyond": dist > rounds, "friction": friction})

    return run


def quarantine(edges: DataFrame, most: int = 25, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges without nodes of degree ``most`` or more, and those nodes; names in ``allowed`` (upper case) stay."""
    deg = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= most)
    if allowed is not None:
        deg = deg.join(allowed.select(F.col(allowed.columns[0]).alias("_n")).distinct(), F.upper("node") == F.col("_n"), "left_anti")
    bad = cut(deg)
    out = edges.join(bad.select(F.col("node").alias("source")), "source", "left_anti").join(bad.select(F.col("node").alias("target")), "target", "left_anti")
    return out, bad


def oriented(spark: SparkSession, edges: DataFrame, strict: bool = True) -> DataFrame:
    """Edges that obey the ontology, turned where only the turn does; adds ``relation`` and the labels.

    Aliases first (some swap the ends).  Labels ENTITY are inferred, alphabetically where several fit.
    Symmetric relations come out with the smaller end first.  Others are left out (kept unchecked if not strict and unknown).
    """
    dim = spark.createDataFrame([(r, sorted(a), sorted(b), s) for r, (a, b, s) in ONTOLOGY.items()], "relation string, dom array<string>, rng array<string>, sym boolean")
    alias = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(v[0])) for k, v in ALIASES.items()]))
    swap = F.upper(F.trim("rel_type")).isin(*[k for k, v in ALIASES.items() if v[1]])
    label = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(v)) for k, v in LABELS.items()]))
    norm = lambda c: F.coalesce(label[F.upper(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("ENTITY"))))], F.upper(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("ENTITY")))))
    raw = F.upper(F.trim("rel_type"))
    x = edges.withColumn("relation", F.coalesce(alias[raw], raw)).withColumn("_sl", norm("source_type")).withColumn("_tl", norm("target_type"))
    x = x.withColumn("_e", F.when(swap, F.array("target", "source", "_tl", "_sl")).otherwise(F.array("source", "target", "_sl", "_tl")))
    x = x.join(F.broadcast(dim), "relation", "left")
    s, t, sl, tl = (F.col("_e")[i] for i in range(4))
    ok = F.array_contains("dom", sl) & F.array_contains("rng", tl)
    turn = F.array_contains("dom", tl) & F.array_contains("rng", sl)
    first = lambda c: F.element_at(F.sort_array(c), 1)
    people = F.col("relation").isin("CEO_OF", "EXECUTIVE_OF", "DIRECTOR_OF", "INSIDER_OF")
    either = (sl == "ENTITY") & (tl == "ENTITY")
    fixed = (
        F.when(F.col("dom").isNull(), F.lit(None) if strict else F.array(s, t, sl, tl)).when(ok, F.array(s, t, sl, tl)).when(turn, F.array(t, s, tl, sl))
        .when(either & people, F.array(s, t, F.lit("PERSON"), F.lit("COMPANY"))).when(either, F.array(s, t, first("dom"), first("rng")))
        .when(people & (sl == "ENTITY") & F.array_contains("rng", tl), F.array(s, t, F.lit("PERSON"), tl)).when(people & (tl == "ENTITY") & F.array_contains("rng", sl), F.array(t, s, F.lit("PERSON"), sl))
        .when((sl == "ENTITY") & F.array_contains("rng", tl), F.array(s, t, first("dom"), tl)).when((tl == "ENTITY") & F.array_contains("dom", sl), F.array(s, t, sl, first("rng")))
    )
    x = x.withColumn("_f", fixed.cast("array<string>")).where("_f is not null")
    flip = F.coalesce(F.col("sym"), F.lit(False)) & (F.col("_f")[0] > F.col("_f")[1])
    x = x.withColumn("_f", F.when(flip, F.array(F.col("_f")[1], F.col("_f")[0], F.col("_f")[3], F.col("_f")[2])).otherwise(F.col("_f")))
    keep = [c for c in edges.columns if c not in ("source", "target", "source_type", "target_type")]
    return x.select(*keep, "relation", *[F.col("_f")[i].alias(n) for i, n in enumerate(("source", "target", "source_type", "target_type"))])


def acyclic_ownership(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)`` of edges with ``(source, target, rel_type, confidence, ordinal)``: the weakest edge of each found cycle goes until none is left.

    Only ``SUBSIDIARY_OF`` and, turned round, ``PARENT_OF`` are ownership; other relations are kept.
    Only edges inside a strong component are looked at, component by component.  Null
    confidence counts as 0.5.
    """
    import pandas as pd

    rel = F.upper(F.trim("rel_type"))
    turned = rel == "PARENT_OF"
    owns = edges.where(rel.isin("SUBSIDIARY_OF", "PARENT_OF")).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    e = owns.select(F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"), "confidence", "ordinal")
    scc = cut(strong_components(e))
    a, b = scc.select(F.col("node").alias("source"), "scc"), scc.select(F.col("node").alias("target"), F.col("scc").alias("_s"))
    inner = e.join(a, "source").join(b, "target").where("scc = _s").select("scc", "source", "target", "confidence", "ordinal")

    def weakest(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = _break_cycles(sorted(zip(pdf.ordinal, pdf.source, pdf.target, pdf.confidence)))
        return pd.DataFrame({"ordinal": pd.Series(gone, dtype="int64")})

    dropped = cut(inner.groupBy("scc").applyInPandas(weakest, "ordinal long"))
    return edges.join(dropped, "ordinal", "left_anti"), edges.join(dropped, "ordinal", "left_semi")


def _break_cycles(rows: list[tuple]) -> list[int]:
    """Ordinals of the edges ``(ordinal, source, target, confidence)`` that a depth-first search drops, started anew after each cycle found.

    It is not started anew: it goes back to the source of the dropped edge, where a new
    start would come by the same path.  Nodes finished before stay finished, since no edge
    leads from them to a cycle, and each node keeps its place among its edges.  So the work
    is that of one search and, for each cycle, the path behind the dropped edge.
    """
    out: dict = {}
    for o, s, t, c in rows:
        out.setdefault(s, []).append((t, (c, o)))
    at = dict.fromkeys(out, 0)
    done: set = set()
    gone: list[int] = []
    for root in sorted(out):
        if root in done:
            continue
        path, taken, place = [root], [], {root: 0}
        while path:
            node = path[-1]
            edges = out.get(node, ())
            i = at.get(node, 0)
            while i < len(edges) and edges[i][0] in done:
                i += 1
            at[node] = i
            if i == len(edges):
                done.add(path.pop())
                del place[node]
                if taken:
                    taken.pop()
                continue
            t, edge = edges[i]
            k = place.get(t)
            if k is None:
                place[t] = len(path)
                path.append(t)
                taken.append(edge)
                continue
            low = min([*taken[k:], edge])
            gone.append(low[1])
            d = len(path) - 1 if low is edge else taken.index(low, k)
            at[path[d]] += 1
            for n in path[d + 1 :]:
                del place[n]
            del path[d + 1 :], taken[d:]
    return gone


def close_states(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges whose pair (either way) has a terminal event end at the first one, if open or later."""
    k = events.groupBy(F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).agg(F.min("day").alias("_day"))
    x = edges.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target")).join(k, ["_a", "_b"], "left")
    end = F.when(F.col("_day").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_day"))), F.col("_day")).otherwise(F.col("valid_to"))
    return x.withColumn("valid_to", end).drop("_a", "_b", "_day")


def resolve(nodes: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, canonical, mention_count)``: components of accepted links; the longest id stands for its component."""
    c = connected_components(links, "a", "b")
    x = nodes.select(F.col(id_col).alias("node")).distinct().join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = x.groupBy("component").agg(F.min_by("node", F.struct(-F.length("node"), "node")).alias("canonical"), F.count("*").alias("mention_count"))
    return x.join(best, "component").select(F.col("node").alias("id"), "canonical", "mention_count")


def first_visit_shock(edges: DataFrame, origin: str, magnitude: float, duration: float, hops: int) -> DataFrame:
    """``(node, parent, hop, duration, magnitude, delay, absorbed)``: a shock that each node takes from the first edge that reaches it.

    ``edges``: ``(source, target, edge, exposure_pct, buffer_days)``.  Nodes are visited in the
    order of the numbers of the edges on their way.  A buffer delays the shock and shortens it;
    where it outlasts the shock a twentieth gets through.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(origin,)], "node string")
    front = spark.createDataFrame([(origin, "", float(magnitude), float(duration), 0.0)], "node string, path string, magnitude double, duration double, delay double")
    out = None
    for hop in range(1, hops + 1):
        x = edges.join(front.withColumnRenamed("node", "source"), "source").join(seen.withColumnRenamed("node", "target"), "target", "left_anti")
        x = x.withColumn("path", F.concat("path", F.lpad(F.col("edge").cast("string"), 12, "0")))
        first = x.groupBy(F.col("target").alias("node")).agg(F.min_by(F.struct("source", "path", "magnitude", "duration", "delay", "exposure_pct", "buffer_days"), "path").alias("f")).select("node", "f.*")
        share = F.when(F.col("duration") > F.col("buffer_days"), 1 - F.col("buffer_days") / F.col("duration")).otherwise(0.0)
        step = first.select(
            "node", F.col("source").alias("parent"), "path", F.lit(hop).alias("hop"), F.greatest(F.lit(0.0), F.col("duration") - F.col("buffer_days")).alias("duration"), (F.col("delay") + F.col("buffer_days")).alias("delay"),
            F.round(F.col("magnitude") * F.col("exposure_pct") / 100 * F.when(share > 0, share).otherwise(0.05), 2).alias("magnitude"), F.round(share, 2).alias("absorbed"),
        )
        step = cut(step)
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            break
        seen, front = seen.unionByName(step.select("node")), step.select("node", "path", "magnitude", "duration", "delay")
    return out.drop("path")


def shock_vectors(rows: DataFrame, ticker: str, car: str, z: str, days: str) -> DataFrame:
    """Adds ``origin, magnitude_pct, duration_days, confidence`` of a shock by event-window figures; 5 % and 90 days where nothing is stated."""
    return rows.withColumns({
        "origin": F.upper(F.trim(F.coalesce(F.col(ticker), F.lit("UNKNOWN")))), "magnitude_pct": F.round(F.abs(F.coalesce(F.col(car), F.lit(5.0))), 2),
        "duration_days": F.coalesce(F.col(days), F.lit(90)), "confidence": F.when(F.coalesce(F.col(z), F.lit(0.0)) <= -2.0, 0.95).otherwise(0.80),
    })
