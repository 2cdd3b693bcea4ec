"""Event graphs and stop graphs as edge tables, and reachability over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import discard, written
from . import relational as R
from .closure import shortest_paths
from .edits import draw


def event_nodes(conn: DataFrame) -> DataFrame:
    """Departure (0) and arrival (1) of each connection, as ``(trip, seq, kind, stop, t)``."""
    return conn.select("trip", "seq", F.lit(0).alias("kind"), F.col("from_stop").alias("stop"), F.col("dep").alias("t")).union(conn.select("trip", "seq", F.lit(1), "to_stop", "arr"))


def _node(trip: str, seq: str, kind: int):
    """One number for an event: trip, place in the trip (below 2 ** 19), kind."""
    return F.col(trip).cast("long") * (1 << 20) + F.col(seq) * 2 + kind


#: Types of edges in order of their names.
TYPES = ("BOARD", "RIDE", "STAY", "WAIT", "WALK_AND_BOARD")


def least_edges(edges: DataFrame) -> DataFrame:
    """``(src, dst, w, etype)`` of ``edges(src, dst, w, type)``: the least weight of each pair, and of equal ones the first type.

    Weight and type go as one number, so pairs are grouped by hash and no text is shuffled.
    """
    both = (F.col("w").cast("long") * 8 + F.col("type")).alias("both")
    least = edges.select("src", "dst", both).groupBy("src", "dst").agg(F.min("both").alias("both"))
    names = F.array(*[F.lit(x) for x in TYPES])
    return least.select("src", "dst", F.floor(F.col("both") / 8).cast("int").alias("w"), F.get(names, F.pmod("both", F.lit(8)).cast("int")).alias("etype"))


def event_edges(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """``(src, dst, w, etype)``, the least weight of each pair of nodes kept once."""
    of = lambda name: F.lit(TYPES.index(name)).alias("type")
    ride = conn.select(_node("trip", "seq", 0).alias("src"), _node("trip", "seq", 1).alias("dst"), (F.col("arr") - F.col("dep")).alias("w"), of("RIDE"))
    stay = R.stay_edges(conn).select(_node("trip", "seq", 1), _node("trip", "nseq", 0), "w", of("STAY"))
    wait = R.wait_edges(conn).select(_node("trip", "seq", 0), _node("ntrip", "nseq", 0), "w", of("WAIT"))
    # arrivals as they are and carried over walks ask for the next departure together; each brings its minute
    at = conn.select("trip", "seq", F.col("arr").alias("since"), F.lit(0).alias("walked"), F.col("to_stop").alias("stop"), F.col("arr").alias("t"))
    on_foot = at.join(walks, at.stop == walks.u).select("trip", "seq", "since", F.lit(1), F.col("v"), F.col("t") + F.col("w"))
    asked = R.board_asof(at.union(on_foot), conn, ["trip", "seq", "since", "walked"])
    board = asked.select(_node("trip", "seq", 1), _node("btrip", "bseq", 0), F.col("bdep") - F.col("since"), F.when(F.col("walked") == 1, TYPES.index("WALK_AND_BOARD")).otherwise(TYPES.index("BOARD")))
    return least_edges(ride.union(stay).union(wait).union(board))


def event_metrics(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """``(n_nodes, n_edges, most_out)`` of :func:`event_edges` of whole connections, counted without the edges.

    A departure has its ride and, but for the last of its stop, a wait.  An arrival has an edge to
    a departure of each stop, its own or walked to, that has one from then on, and a stay; the stay
    is the same edge as one of these where the departure before at the stop leaves too early.
    """
    walks = walks.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))
    order = Window.partitionBy("trip").orderBy("seq")
    at = conn.select("trip", "seq", F.col("from_stop").alias("stop"), "to_stop", "dep", "arr", F.lag("to_stop").over(order).alias("came"), F.lag("arr").over(order).alias("since"), F.lead("seq").over(order).isNull().alias("last"))
    at = written(at, "events")
    before = R.departed_before(at.select("stop", "dep", "trip", "seq", "came", "since"))
    here = before.where("came = stop").select("came", "since", (F.expr("dep >= since and (near is null or near < since)")).cast("int").alias("same"))
    gaps = before.where("came <> stop").join(walks.select(F.col("u").alias("came"), F.col("v").alias("stop"), "w"), ["came", "stop"], "left")
    gaps = gaps.select("came", "since", F.coalesce(F.expr("dep >= since + w and (near is null or near < since + w)"), F.lit(False)).cast("int").alias("same"))
    come = here.union(gaps).select(F.col("came").alias("stop"), F.col("since").alias("t"), (1 - F.col("same")).alias("more"))
    come = come.union(at.where("last").select("to_stop", "arr", F.lit(0))).groupBy("stop", "t", "more").agg(F.count("*").alias("n"))
    # until when a stop's arrivals find a departure at each of the stops near it
    ends = written(at.groupBy("stop").agg(F.max("dep").alias("dep"), F.count("*").alias("n")), "ends")
    near = ends.select("stop", F.col("dep").alias("until")).union(walks.join(ends.select(F.col("stop").alias("v"), "dep"), "v").select("u", F.col("dep") - F.col("w")))
    near = near.groupBy("stop").agg(F.collect_list("until").alias("until"))  # as many as a stop's walks
    out = come.join(near, "stop", "left").select("n", (F.col("more") + F.coalesce(F.size(F.filter("until", lambda x: x >= F.col("t"))), F.lit(0))).cast("long").alias("out"))
    arrivals = out.agg(F.sum(F.col("n") * F.col("out")).alias("edges"), F.max("out").alias("most"))
    leave = ends.agg(F.sum("n").alias("rides"), F.sum(F.col("n") - 1).alias("waits"), F.max(F.when(F.col("n") > 1, 2).otherwise(1)).cast("long").alias("most"))
    both = leave.select("rides", "waits", F.col("most").alias("a")).join(arrivals.select("edges", F.col("most").alias("b")), F.lit(True))  # a row each
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select((2 * none("rides")).alias("n_nodes"), (none("rides") + none("waits") + none("edges")).alias("n_edges"), F.greatest("a", "b").alias("most_out"))


def reach(edges: DataFrame, seeds: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Nodes that each query reaches, with their minutes: ``edges(src, dst, w)``, ``seeds(q_id, node, t, low, high)``.

    All weights are differences of the ends' minutes, so whether a node is reached says when.
    Nodes before ``low`` or after ``high``, and those not in ``within``, are not entered.
    """
    seen = written(seeds.where("t between low and high").distinct(), "seen")
    front, used = seen, []
    while True:
        step = front.join(edges.select(F.col("src").alias("node"), "dst", "w"), "node").select("q_id", F.col("dst").alias("node"), (F.col("t") + F.col("w")).alias("t"), "low", "high")
        step = step.where("t between low and high").distinct()
        if within is not None:
            step = step.join(within, ["q_id", "node"], "left_semi")
        front = written(step.join(seen, ["q_id", "node"], "left_anti"), "front")
        discard(*used)
        if front.isEmpty():
            discard(front)
            return seen
        used = [seen, front]  # read until the next step is written
        seen = written(seen.union(front), "seen")


#: Minutes after its start that a query's search looks at first; twice as many each time it has found nothing.
HORIZON = 64


def earliest_on_events(conn: DataFrame, walks: DataFrame, od: DataFrame, edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """Earliest arrivals by reachability on the event graph; with ``both_ways`` from both ends.

    From both ends, the nodes that lead to a target are found first and the forward search
    keeps to them.  No node after a query's horizon is entered: an arrival within it cannot
    be bettered beyond it, and queries without one go on with a longer horizon.
    """
    seeds = written(R.first_departures(od, conn, walks).select("q_id", _node("trip", "seq", 0).alias("node"), F.col("dep").alias("t")), "seeds")
    goals = written(R.target_attachment(od, conn, walks).select("q_id", _node("trip", "seq", 1).alias("node"), F.col("arr").alias("t"), (F.col("arr") + F.col("tail")).alias("ea")), "goals")
    back_edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("w")).alias("w"))
    last = conn.agg(F.max("arr")).first()[0]
    left, ridden, span = od.select("q_id", "t_dep"), None, HORIZON
    while last is not None:
        bounds = left.select("q_id", F.col("t_dep").alias("low"), (F.col("t_dep") + span).alias("high"))
        start = seeds.join(bounds, "q_id")
        ends = goals.join(bounds, "q_id").where("ea <= high")
        back = None
        if both_ways:
            back = reach(back_edges, ends.select("q_id", "node", "t", "low", "high")).select("q_id", "node")
            start = start.join(back, ["q_id", "node"], "left_semi")
        front = reach(edges, start.select("q_id", "node", "t", "low", "high"), back)
        found = front.join(ends.select("q_id", "node", "ea"), ["q_id", "node"]).groupBy("q_id").agg(F.min("ea").alias("ridden"))
        found = written(found, "ridden")
        ridden = found if ridden is None else ridden.union(found)
        left = written(left.join(found, "q_id", "left_anti").where(F.col("t_dep") + span <= last), "left")
        if left.isEmpty():
            break
        span *= 2
    walked = od.join(walks, (F.col("src") == F.col("u")) & (F.col("dst") == F.col("v")), "left").select("q_id", F.when(F.col("src") == F.col("dst"), F.col("t_dep")).otherwise(F.col("t_dep") + F.col("w")).alias("walked"))
    out = od.join(walked, "q_id", "left")
    out = out.join(ridden, "q_id", "left") if ridden is not None else out.withColumn("ridden", F.lit(None).cast("int"))
    return out.select("q_id", "src", "dst", "t_dep", F.least("ridden", "walked").cast("int").alias("ea"))


def static_graph(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """Least ride or walk between neighbouring stops, whatever the hour."""
    rides = conn.select(F.col("from_stop").alias("u"), F.col("to_stop").alias("v"), (F.col("arr") - F.col("dep")).alias("w"))
    return rides.union(walks.select("u", "v", "w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def lower_bound_graph(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """The static graph with hops across gaps of a trip, so that its distances bound every ride."""
    gaps = R.gap_stay_edges(conn).select("u", "v", "w")
    return static_graph(conn, walks).union(gaps).where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def stop_graph(conn: DataFrame, legs: DataFrame) -> DataFrame:
    """Rides of some minutes and unclosed walks, one at least each."""
    return static_graph(conn.where("arr > dep"), legs.select("u", "v", F.greatest(F.lit(1), "w").alias("w")))


def landmarks(graph: DataFrame, k: int) -> list[int]:
    """Stops far from each other: the first has the smallest number, each next is the furthest.

    Stops that those chosen do not reach count as nearest; of equally far ones the smallest
    number is taken.
    """
    first = graph.agg(F.min("u")).first()[0]
    chosen = [] if first is None else [first]
    spark, near = graph.sparkSession, None
    while chosen and len(chosen) < k:
        d = shortest_paths(graph, spark.createDataFrame([(chosen[-1],)], "root int")).select("v", "d")
        near = written(d if near is None else near.union(d).groupBy("v").agg(F.min("d").alias("d")), "near")
        far = near.where(~F.col("v").isin(chosen)).orderBy(F.desc("d"), "v").first()
        if far is None:
            break
        chosen.append(far.v)
    return chosen


def landmark_worlds(graph: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """``(world, pos, stop)``: the selection of :func:`landmarks` from each of ``starts(world, stop)``.

    All worlds advance in one search: a step looks for paths from the stops that any of them
    chose last, and each takes its furthest stop by one aggregate.  A world that reaches
    fewer stops than ``k`` has as many landmarks as it reaches.
    """
    chosen = last = written(starts.select("world", F.lit(0).alias("pos"), "stop"), "chosen")
    near = None
    for pos in range(1, k):
        paths = shortest_paths(graph, last.select(F.col("stop").alias("root")).distinct())
        new = last.select("world", F.col("stop").alias("root")).join(paths, "root").select("world", "v", "d")
        grown = written(new if near is None else near.union(new).groupBy("world", "v").agg(F.min("d").alias("d")), "near")
        discard(paths, *([] if near is None else [near]))
        near = grown
        rest = near.join(chosen.select("world", F.col("stop").alias("v")), ["world", "v"], "left_anti")
        far = rest.groupBy("world").agg(F.max(F.struct("d", (-F.col("v")).alias("stop"))).alias("far"))
        last = written(far.select("world", F.lit(pos).alias("pos"), (-F.col("far.stop")).alias("stop")), "last")
        if last.isEmpty():
            break
        chosen = chosen.union(last)
    if near is not None:
        discard(near)
    return chosen


def landmark_restarts(graph: DataFrame, k: int, restarts: int, sources: int, targets: int, seed: int) -> DataFrame:
    """``(world, pos, stop, n_pairs, quality, best)``: selections from several first stops, judged on the same pairs.

    First stops are drawn by hash among those with edges; pairs as in :func:`landmark_quality`.
    ``quality`` is the mean share of the true distance that a selection's bounds reach, each
    share cut to millionths, so that it is the same in whatever order it is summed; the best
    selection is the first of the highest quality.  Without pairs the quality is 0.
    """
    stops = graph.select(F.col("u").alias("stop")).distinct().orderBy(draw("stop", seed=seed + 1), "stop").limit(restarts)
    starts = stops.select((F.row_number().over(Window.orderBy(draw("stop", seed=seed + 1), "stop")) - 1).alias("world"), "stop")  # a row a restart
    chosen = written(landmark_worlds(graph, starts, k), "worlds")
    labels = landmark_labels(graph, chosen.select(F.col("stop").alias("root")).distinct())
    pairs = true_distances(graph, sources, targets, seed)
    scores = chosen.select("world", F.col("stop").alias("lm")).join(landmark_scores(labels, pairs), "lm")
    bounds = scores.groupBy("world", "q_id").agg(F.max("score").alias("lb"))
    share = bounds.join(pairs.select("q_id", "d"), "q_id").groupBy("world").agg(F.sum(F.expr("cast(lb as bigint) * 1000000 div d")).alias("parts"))
    n = pairs.agg(F.count("*").alias("n_pairs"))
    judged = chosen.join(share, "world", "left").join(F.broadcast(n), F.lit(True))  # n is one row
    quality = F.when(F.col("n_pairs") > 0, F.coalesce("parts", F.lit(0)) / (F.col("n_pairs") * 1000000)).otherwise(0.0)
    judged = written(judged.select("world", "pos", "stop", "n_pairs", quality.alias("quality")), "judged")
    top = judged.groupBy().agg(F.max(F.struct("quality", (-F.col("world")).alias("world"))).alias("top")).select((-F.col("top.world")).alias("top"))
    return judged.join(F.broadcast(top), F.lit(True)).select("world", "pos", "stop", "n_pairs", "quality", (F.col("world") == F.col("top")).alias("best"))  # top is one row


def landmark_labels(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """``(lm, stop, d_from, d_to)``: minutes from and to each landmark."""
    out = shortest_paths(graph, roots).select(F.col("root").alias("lm"), F.col("v").alias("stop"), F.col("d").alias("d_from"))
    back = shortest_paths(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"), roots).select(F.col("root").alias("lm"), F.col("v").alias("stop"), F.col("d").alias("d_to"))
    return out.join(back, ["lm", "stop"], "full_outer")


def landmark_scores(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each landmark's lower bound of the time between ``pairs(q_id, src, dst)``."""
    s = labels.select("lm", F.col("stop").alias("src"), F.col("d_from").alias("sf"), F.col("d_to").alias("st"))
    t = labels.select("lm", F.col("stop").alias("dst"), F.col("d_from").alias("tf"), F.col("d_to").alias("tt"))
    both = pairs.join(s, "src").join(t, ["lm", "dst"])
    score = F.greatest(F.coalesce(F.col("st") - F.col("tt"), F.lit(0)), F.coalesce(F.col("tf") - F.col("sf"), F.lit(0)), F.lit(0))
    return both.select("q_id", "src", "dst", "lm", score.alias("score"))


def lower_bounds(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    return landmark_scores(labels, pairs).groupBy("q_id", "src", "dst").agg(F.max("score").alias("lb"))


def front_bounds(labels: DataFrame, active: DataFrame | None = None):
    """A function that adds ``lb``, the best landmark's bound, to ``front(q_id, stop, t, dst)``.

    Bounds are joined for the front's own stops only, and for each query's ``active(q_id, lm)``
    landmarks where they are given; a stop that no landmark knows has none.
    """
    s = labels.select("lm", "stop", F.col("d_from").alias("sf"), F.col("d_to").alias("st"))
    t = labels.select("lm", F.col("stop").alias("dst"), F.col("d_from").alias("tf"), F.col("d_to").alias("tt"))

    def add(front: DataFrame) -> DataFrame:
        if active is None:
            both = front.join(s, "stop", "left").join(t, ["lm", "dst"], "left")
        else:
            both = front.join(active.select("q_id", "lm"), "q_id", "left").join(s, ["lm", "stop"], "left").join(t, ["lm", "dst"], "left")
        score = F.greatest(F.coalesce(F.col("st") - F.col("tt"), F.lit(0)), F.coalesce(F.col("tf") - F.col("sf"), F.lit(0)), F.lit(0))
        return both.groupBy("q_id", "stop", "t", "goal", "high", "dst").agg(F.max(score).alias("lb"))

    return add


def active_landmarks(labels: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` landmarks with the best bounds for each query; of equal ones the smallest."""
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "lm")
    return landmark_scores(labels, pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "lm", "rank", "score")


def true_distances(graph: DataFrame, sources: int, targets: int, seed: int) -> DataFrame:
    """``(q_id, src, dst, d)`` of pairs drawn by hash: some stops with edges, and for each some of the stops it reaches."""
    drawn = graph.select(F.col("u").alias("root")).distinct().orderBy(draw("root", seed=seed), "root").limit(sources)
    true = shortest_paths(graph, drawn).where("d > 0")
    w = Window.partitionBy("root").orderBy(draw("root", "v", seed=seed), "v")
    pairs = true.withColumn("k", F.row_number().over(w)).where(F.col("k") <= targets)
    return written(pairs.select((F.col("root").cast("long") * 1_000_000_000 + F.col("v")).alias("q_id"), F.col("root").alias("src"), F.col("v").alias("dst"), "d"), "pairs")


def landmark_quality(graph: DataFrame, labels: DataFrame, sources: int, targets: int, seed: int) -> DataFrame:
    """How much of the true distance the best landmark's bound reaches, on average over :func:`true_distances`."""
    pairs = true_distances(graph, sources, targets, seed)
    ratio = pairs.join(lower_bounds(labels, pairs).select("q_id", "lb"), "q_id", "left").select((F.coalesce("lb", F.lit(0)) / F.col("d")).alias("ratio"))
    return ratio.agg(F.count("*").alias("n_pairs"), F.avg("ratio").alias("quality"))


def topological_levels(nodes: DataFrame) -> DataFrame:
    """Events numbered in order of minute and node: ranks within a minute, shifted by those before."""
    with_id = nodes.select(_node("trip", "seq", 0).alias("base"), "kind", "t").select((F.col("base") + F.col("kind")).alias("node"), "t")
    per = with_id.groupBy("t").agg(F.count("*").alias("n"))
    per = per.select("t", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a minute
    return with_id.join(per, "t").select("node", "t", (F.col("before") + F.row_number().over(Window.partitionBy("t").orderBy("node")) - 1).alias("level"))


def hub_labels(graph: DataFrame, n_hubs: int, cap: int) -> DataFrame:
    """Distances within ``cap`` from the ``n_hubs`` stops of most edges, as ``(hub, rank, v, d)``."""
    degree = graph.select("u").union(graph.select("v")).groupBy(F.col("u").alias("root")).agg(F.count("*").alias("degree"))
    hubs = degree.orderBy(F.desc("degree"), "root").limit(n_hubs)
    rank = hubs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "root")).cast("int"))  # n_hubs rows
    return shortest_paths(graph, hubs.select("root"), cap).join(rank, "root").select(F.col("root").alias("hub"), "rank", "v", "d")
