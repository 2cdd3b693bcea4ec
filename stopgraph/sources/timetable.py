"""Timetables: stop times to connections, walks and query sets, and files of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.minutes import minutes_since, walk_minutes
from ..operators.closure import walk_closure
from ..operators.relational import collapse_same_stop, service_date

#: Numbers of the modes of transport.
MODES = {"bus": 0, "subway": 1, "Tram": 2, "boat": 3, "walking": 4}

OD_SCHEMA = "q_id int, src int, dst int, t_dep int"
STOP_TIMES_SCHEMA = "trip_id string, stop_sequence int, stop_int int, stop_name string, stop_lat double, stop_lon double, arrival_time timestamp, departure_time timestamp, route_int int, Mode string"


@dataclass
class Timetable:
    """A service day: connections (trip, seq, from_stop, to_stop, dep, arr, route_int, mode), walks (u, v, w), queries."""

    connections: DataFrame
    walks: DataFrame
    od: DataFrame


def mode_number(name: Column) -> Column:
    """The mode's number; an unknown name is a bus."""
    out = F.lit(0)
    for mode, k in MODES.items():
        out = F.when(name == mode, k).otherwise(out)
    return out


def connections(stop_times: DataFrame, t_lo: int | None = None, t_hi: int | None = None) -> DataFrame:
    """Pair each stop of a trip with the next one; rows without times break no pair, they drop it.

    ``stop_times(trip, seq, stop, arr, dep, route_int, mode)`` in minutes.  Pairs of one stop
    with itself are dropped, and so are those outside the service window.
    """
    next_ = Window.partitionBy("trip").orderBy("seq")
    out = stop_times.withColumn("to_stop", F.lead("stop").over(next_)).withColumn("next_arr", F.lead("arr").over(next_))
    out = out.select("trip", "seq", F.col("stop").alias("from_stop"), "to_stop", "dep", F.col("next_arr").alias("arr"), "route_int", "mode")
    out = out.where("to_stop is not null and from_stop <> to_stop and dep is not null and arr is not null")
    if t_lo is not None:
        out = out.where((F.col("dep") >= t_lo) & (F.col("dep") < t_hi) & (F.col("arr") >= t_lo) & (F.col("arr") <= t_hi))
    return out


def stop_subset(conn: DataFrame, stops: DataFrame) -> DataFrame:
    """Connections with both ends in ``stops(stop)``."""
    return conn.join(stops.select(F.col("stop").alias("from_stop")), "from_stop", "left_semi").join(stops.select(F.col("stop").alias("to_stop")), "to_stop", "left_semi")


def walk_subset(walks: DataFrame, stops: DataFrame) -> DataFrame:
    """Walks with both ends in ``stops(stop)``."""
    return walks.join(stops.select(F.col("stop").alias("u")), "u", "left_semi").join(stops.select(F.col("stop").alias("v")), "v", "left_semi")


def raw_walks(footpaths: DataFrame) -> DataFrame:
    """Minutes of ``footpaths(u, v, walk_seconds)``, the least of each pair."""
    return footpaths.select("u", "v", walk_minutes(F.col("walk_seconds")).alias("w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def expand_slices(offsets: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of a sliced adjacency: ``offsets(u, lo, hi)`` and ``targets(pos, v, walk_seconds)``."""
    at = offsets.where("hi > lo").select("u", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("pos"))
    return at.join(targets, "pos").select("u", "v", "walk_seconds")


def from_feed(stop_times: DataFrame, footpaths: DataFrame, od: DataFrame, service_start: int, t_lo: int = 0, t_hi: int = 780, cap: int = 15, stops: DataFrame | None = None) -> Timetable:
    """A timetable from a raw feed: ``STOP_TIMES_SCHEMA`` and ``footpaths(u, v, walk_seconds)``.

    Runs of one stop are one stop, times become minutes since ``service_start`` (seconds of
    the epoch), trips are numbered in order of their ids, connections outside the window or
    the ``stops(stop)`` asked for are left out, and walks are closed up to ``cap`` minutes.
    """
    merged = collapse_same_stop(stop_times.select(F.col("trip_id").alias("trip"), "stop_sequence", F.col("stop_int").alias("stop"), "arrival_time", "departure_time", "route_int", F.col("Mode").alias("mode")))
    rows = merged.select("trip", F.col("stop_sequence").alias("seq"), "stop", minutes_since(F.col("arrival_time"), service_start).alias("arr"), minutes_since(F.col("departure_time"), service_start).alias("dep"), "route_int", mode_number(F.col("mode")).alias("mode"))
    conn = connections(rows, t_lo, t_hi)
    walks = raw_walks(footpaths)
    if stops is not None:
        conn, walks = stop_subset(conn, stops), walk_subset(walks, stops)
    order = Window.partitionBy("head").orderBy("trip")
    # ids that begin alike are numbered apart and shifted by those before
    ids = conn.select("trip").distinct().withColumn("head", F.substring("trip", 1, 4))
    sizes = ids.groupBy("head").agg(F.count("*").alias("n"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # a row for each head
    sizes = sizes.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ids = ids.join(sizes, "head").select("trip", (F.col("start") + F.row_number().over(order) - 1).cast("int").alias("number"))
    conn = conn.join(ids, "trip").select(F.col("number").alias("trip"), *[c for c in conn.columns if c != "trip"])
    return Timetable(conn, walk_closure(walks, cap), od)


def load_feed(spark: SparkSession, path: str, t_lo: int = 0, t_hi: int = 780, cap: int = 15, service_start: int | None = None, stops: DataFrame | None = None) -> Timetable:
    """A timetable from the tables ``stop_times``, ``footpaths`` and ``od`` under ``path``.

    Without ``service_start``, service begins at 07:00 of the commonest date of departures.
    """
    st, footpaths = read_stop_times(spark, f"{path}/stop_times"), spark.read.schema("u int, v int, walk_seconds int").parquet(f"{path}/footpaths")
    if service_start is None:
        day = service_date(st).select(F.unix_timestamp(F.col("service_date").cast("timestamp"))).first()
        if day is None:
            raise ValueError("the feed has no departures")
        service_start = day[0] + 7 * 3600
    return from_feed(st, footpaths, spark.read.schema(OD_SCHEMA).parquet(f"{path}/od"), service_start, t_lo, t_hi, cap, stops)


# ---- sources and sinks -------------------------------------------------------------------


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of queries; a file that lacks a column is refused."""
    head = spark.read.option("header", True).csv(path)
    if missing := [c for c in ("q_id", "src", "dst", "t_dep") if c not in head.columns]:
        raise ValueError(f"the query file lacks {', '.join(missing)}")
    return head.select(*[F.expr(f"try_cast({c} as int)").alias(c) for c in ("q_id", "src", "dst", "t_dep")])


def read_stop_times(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOP_TIMES_SCHEMA).parquet(path)


def result_lines(result: DataFrame) -> DataFrame:
    """Canonical text of results: a line a query, 'None' where a stop is not reached."""
    return result.select("q_id", F.concat_ws(",", *[F.col(c).cast("string") for c in ("q_id", "src", "dst", "t_dep")], F.coalesce(F.col("ea").cast("string"), F.lit("None"))).alias("line"))


def write_results(result: DataFrame, path: str, rows: int = 200) -> None:
    """Results in order of their queries, in files of ``rows`` each: a file is written as soon as it is full."""
    result.orderBy("q_id").write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


#: Parts of a folder's name, or its parent's, that tell a dataset, in order of precedence.
TAGS = {"full": "full_london", "berlin": "berlin", "nyc": "nyc", "newyork": "nyc", "new_york": "nyc", "paris": "paris", "subset": "subset"}


def dataset_tag(path: str) -> str:
    """A short name for the dataset in a folder; a folder of another name stands for itself."""
    parts = [x for x in path.lower().split("/") if x not in ("", ".")][-2:]
    return next((tag for mark, tag in TAGS.items() if any(mark in x for x in parts)), parts[-1] if parts else "generic")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each file under ``path`` with its size and SHA-256."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def save(timetable: Timetable, path: str) -> None:
    """Write a timetable's tables, connections in order of departure for pruning by minute."""
    timetable.connections.repartitionByRange("dep").sortWithinPartitions("dep", "arr").write.mode("overwrite").parquet(f"{path}/connections")
    timetable.walks.write.mode("overwrite").parquet(f"{path}/walks")
    timetable.od.write.mode("overwrite").parquet(f"{path}/od")


def load(spark: SparkSession, path: str) -> Timetable:
    return Timetable(*(spark.read.parquet(f"{path}/{n}") for n in ("connections", "walks", "od")))


# ---- a timetable derived from the driver's tables ---------------------------------------

CAP, T_HI = 15, 780


def adapter_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a trip, every line of it a stop at the line's supplier; some stops have no times."""
    order = Window.partitionBy("trip").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    mode = F.when(F.col("l_returnflag") == "A", "subway").when(F.col("l_returnflag") == "R", "Tram").otherwise("bus")
    # the trip's number goes first, so what follows by trip finds its rows together
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("int").alias("trip"), "l_linenumber", "l_suppkey", "l_partkey", mode_number(mode).alias("mode"))
    run, dwell = 3 + F.col("l_partkey") % 8, F.col("l_linenumber") % 3
    arr = (F.col("trip").cast("long") * 37) % 600 + F.sum(run + dwell).over(order) - dwell
    out = li.select("trip", (F.row_number().over(order) - 1).alias("seq"), F.col("l_suppkey").alias("stop"), arr.alias("arr"), (arr + dwell).alias("dep"), (F.col("trip") % 50).alias("route_int"), "mode")
    missing = (F.col("trip") % 23 == 5) & (F.col("seq") == 2)
    out = out.withColumns({c: F.when(~missing, F.col(c)) for c in ("arr", "dep")})
    return out.select(*[F.col(c).cast("int") for c in out.columns])


def adapter_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's stop times with departures missing, and others a day part too late."""
    dep = F.when((F.col("trip") % 31 == 4) & (F.col("seq") % 3 == 1), None).when((F.col("trip") % 41 == 7) & (F.col("seq") == 1), F.col("dep") + 900).otherwise(F.col("dep"))
    return adapter_stop_times(spark, sf_dir).withColumn("dep", dep)


def adapter(spark: SparkSession, sf_dir: str, cap: int = CAP) -> Timetable:
    stops = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("stop"))
    near = stops.select(F.col("stop").alias("u"), F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])).alias("d"))
    walks = near.withColumn("v", F.col("u") + F.col("d")).join(stops.select(F.col("stop").alias("v")), "v", "left_semi").select("u", "v", (4 + 3 * F.abs("d")).alias("w"))
    n = F.broadcast(stops.agg(F.count("*").cast("int").alias("n")))  # one row
    od = spark.range(20).select(F.col("id").cast("int").alias("q_id")).join(n, F.lit(True))
    od = od.select("q_id", ((F.col("q_id") * 13) % F.col("n")).alias("src"), ((F.col("q_id") * 29 + 7) % F.col("n")).alias("dst"), (60 + (F.col("q_id") * 17) % 300).alias("t_dep"))
    return Timetable(connections(adapter_stop_times(spark, sf_dir), 0, T_HI), walk_closure(walks, cap, 7), od)


def adapter_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times with timestamps, every fourth row doubled at the same stop, some without times."""
    st = adapter_stop_times(spark, sf_dir)
    copy = F.explode(F.when(F.col("trip") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    st = st.withColumn("copy", copy)
    start = F.lit(1735887600).cast("long")  # 07:00 of the service date
    at = lambda c: F.when((F.col("trip") % 97 == 5) & (F.col("seq") == 1), F.lit(None)).otherwise(F.timestamp_seconds(start + (F.col(c) + F.col("copy")) * 60 + F.col("trip") % 60 - F.when(F.col("trip") % 89 == 3, 40000).otherwise(0)))
    return st.select("trip", (F.col("seq") * 2 + F.col("copy")).alias("stop_sequence"), "stop", at("arr").alias("arrival_time"), at("dep").alias("departure_time"), "route_int", "mode")
