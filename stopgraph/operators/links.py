"""The event graph's links kept by stop and slot, and repaired where edits touch them.

A link answers an event's question for the next departure at a stop: that of a departure
(waiting), of an arrival (boarding) and of an arrival carried over a walk.  Questions and
answers lie in partitions of slots and areas (stops by remainder), a row a stop with all of
its slot in order, and the departures of each stop and slot in a table beside them.  When
connections go or come, only these partitions are asked again: those of questions that go or
come, and where a departure changed those of the slots before it back to the last one that
still has a departure.  Other partitions are neither read nor written.

Questions cross the network once when they are asked, as two numbers beside their partition;
what a slot does not answer is found in it as one more row, the first departure after it.
Connections have a trip and place of their own, and walks a pair of stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import discard, written
from . import relational as R
from .graphs import TYPES, _node, least_edges

#: Groups of stops that a slot's partitions are told apart by; 16 at least where stops have 31 bits.
AREAS = 16
#: ``items``: minute in the slot and how a question came to be, in order of both; ``waits``: minutes, -1 without a departure left.
LINKS = "stop int, items array<int>, events array<long>, waits array<int>, nexts array<long>, slot int, area int"
#: ``leave``: minute in the slot and number of each departure, in order; empty where a repair has taken all.
DEPARTURES = "stop int, slot int, leave array<long>, area int"
#: How a question came to be: 0 an arrival, 1 and the minutes of a walk, or this, a departure.
_LEAVES = (1 << 28) - 1
#: Items from here on are no questions but the first departure after the slot.
_BEYOND = R.SLOT - 8 << 28


def _area() -> Column:
    return F.pmod("stop", F.lit(AREAS)).cast("int").alias("area")


def _departing(conn: DataFrame) -> DataFrame:
    return conn.select(F.col("from_stop").alias("stop"), F.col("dep").alias("t"), F.lit(_LEAVES).alias("how"), _node("trip", "seq", 0).alias("event"))


def _questions(conn: DataFrame, walks: DataFrame) -> DataFrame:
    """``(slot, area, key, event)`` of departures, arrivals and walked arrivals; see :func:`_packed`."""
    come = conn.select(F.col("to_stop").alias("stop"), F.col("arr").alias("t"), F.lit(0), _node("trip", "seq", 0))
    on_foot = conn.join(walks, F.col("to_stop") == F.col("u")).select(F.col("v").alias("stop"), (F.col("arr") + F.col("w")).alias("t"), F.col("w") + 1, _node("trip", "seq", 0))
    return _asked(_departing(conn).union(come).union(on_foot))


def _asked(rows: DataFrame) -> DataFrame:
    item = ((F.pmod("t", F.lit(R.SLOT)) - 8) * (1 << 28) + F.col("how")).cast("int")
    return _packed(rows.select(R._slot("t"), _area(), "stop", item.alias("item"), "event"))


def _packed(rows: DataFrame) -> DataFrame:
    """``(slot, area, key, event)``: the stop within its area and the item are one number."""
    key = F.shiftleft(F.floor(F.col("stop") / AREAS).cast("long"), 32) + F.col("item") + (1 << 31)
    return rows.select("slot", "area", key.alias("key"), "event")


def _stop() -> Column:
    return (F.shiftright("key", 32) * AREAS + F.col("area")).cast("int").alias("stop")


def _item() -> Column:
    return (F.col("key").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int").alias("item")


def _minute() -> Column:
    return F.shiftright("item", 28) + 8


def _how() -> Column:
    return F.col("item").bitwiseAND(F.lit(_LEAVES))


def _leaving(questions: DataFrame) -> DataFrame:
    """``(stop, slot, leave)``: the departures among questions, minute and event as one number in order of both."""
    one = (_minute().cast("long") * (1 << 52) + F.col("event")).alias("one")
    rows = questions.select("slot", _stop(), _item(), "event").where(_how() == _LEAVES).select("stop", "slot", one)
    return rows.groupBy("stop", "slot").agg(F.array_sort(F.collect_list("one")).alias("leave"))


def _beyond(departures: DataFrame, low: int) -> DataFrame:
    """``(slot, area, stop, item, event)``: for each slot from ``low`` on the first departure of the slots after it."""
    before = F.lag("slot").over(Window.partitionBy("stop").orderBy("slot"))  # a row a slot
    rows = departures.where(F.size("leave") > 0).select("stop", "slot", F.get("leave", F.lit(0)).alias("one")).withColumn("since", F.coalesce(before, F.lit(low)))
    minute = F.shiftright(F.col("one") + F.lit(1 << 51), 52)
    event = F.col("one") - minute * (1 << 52)
    item = (F.col("slot") * R.SLOT + minute + (1 << 27) + _BEYOND).cast("int")
    rows = rows.where("since < slot").select("stop", F.explode(F.sequence("since", F.col("slot") - 1)).alias("at"), item.alias("item"), event.alias("event"))
    return rows.select(F.col("at").alias("slot"), _area(), "stop", "item", "event")


def _answered(rows: DataFrame) -> DataFrame:
    """Questions ``(slot, area, stop, item, event)`` of whole partitions, each in one task, with the next departure."""
    order = Window.partitionBy("slot", "area", "stop").orderBy(F.desc("item"), F.desc("event")).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("slot") * R.SLOT + _minute()
    at = F.when(F.col("item") >= _BEYOND, F.struct((F.col("item") - _BEYOND - (1 << 27)).alias("dep"), "event")).when(_how() == _LEAVES, F.struct(t.alias("dep"), "event"))
    found = rows.withColumn("next", F.last(at, ignorenulls=True).over(order)).where(F.col("item") < _BEYOND)
    wait = F.coalesce(F.col("next.dep") - t, F.lit(-1)).cast("int").alias("wait")
    found = found.select("slot", "area", "stop", "item", "event", wait, F.coalesce("next.event", F.lit(-1)).alias("next"))
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("item", "event", "wait", "next")]
    return found.groupBy("slot", "area", "stop").agg(*lists).select("stop", "items", "events", "waits", "nexts", "slot", "area")


def _put(rows: DataFrame, path: str, by: list[str], parts: list | None = None) -> None:
    """Write ``rows`` in partitions; where ``parts`` are given, in place of those, empty ones too."""
    dealt = rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by)
    if parts is None:
        dealt.parquet(path)
        return
    spark = rows.sparkSession
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    place = lambda part: f"{path}/" + "/".join(f"{c}={v}" for c, v in zip(by, part, strict=True))
    files = fs(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = {}
    for part in parts:
        if files.exists(fs(place(part))):
            old[tuple(part)] = {f.getPath().getName() for f in files.listStatus(fs(place(part)))}
    dealt.option("partitionOverwriteMode", "dynamic").parquet(path)
    for part, names in old.items():  # what was not replaced has nothing left
        if names & {f.getPath().getName() for f in files.listStatus(fs(place(part)))}:
            files.delete(fs(place(part)), True)


def build(conn: DataFrame, walks: DataFrame, path: str) -> None:
    """Write the links of a timetable, and the departures, under ``path``."""
    spark, rows = conn.sparkSession, _questions(conn, walks)
    _put(_leaving(_asked(_departing(conn))).withColumn("area", _area()), f"{path}/departures", ["area"])
    low = conn.agg(F.min(F.floor(F.least("dep", "arr") / R.SLOT)).cast("int")).first()[0]
    if low is not None:
        rows = rows.unionByName(_packed(_beyond(read_departures(spark, path), low)))
    rows = rows.repartition("slot", "area").select("slot", "area", _stop(), _item(), "event")
    _put(_answered(rows), f"{path}/links", ["slot", "area"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stop of a slot: its questions, minutes to the next departure (-1: none left) and which that is."""
    return spark.read.schema(LINKS).parquet(f"{path}/links")


def read_departures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEPARTURES).parquet(f"{path}/departures")


def edges(conn: DataFrame, path: str) -> DataFrame:
    """The event graph's edges from the kept links; rides and stays come from the trips of ``conn``.

    Only a stay can join the same nodes as a link, and such a link leads to the trip's own
    departure, so those alone are grouped by their nodes.
    """
    of = lambda name: F.lit(TYPES.index(name)).alias("type")
    ride = conn.select(_node("trip", "seq", 0).alias("src"), _node("trip", "seq", 1).alias("dst"), (F.col("arr") - F.col("dep")).alias("w"), of("RIDE"))
    stay = R.stay_edges(conn).select(_node("trip", "seq", 1).alias("src"), _node("trip", "nseq", 0).alias("dst"), "w", of("STAY"))
    each = F.inline(F.arrays_zip("items", "events", "waits", "nexts")).alias("item", "event", "wait", "next")
    kept = read(conn.sparkSession, path).select(each).where("wait >= 0").withColumn("how", _how())
    own = (F.col("how") != _LEAVES) & (F.shiftright("event", 20) == F.shiftright("next", 20))
    kind = F.when(F.col("how") == _LEAVES, of("WAIT")).when(F.col("how") == 0, of("BOARD")).otherwise(of("WALK_AND_BOARD")).alias("type")
    walked = F.when((F.col("how") == _LEAVES) | (F.col("how") == 0), F.lit(0)).otherwise(F.col("how") - 1)
    link = ((F.col("event") + (F.col("how") != _LEAVES).cast("int")).alias("src"), F.col("next").alias("dst"), (F.col("wait") + walked).cast("int").alias("w"), kind)
    names = F.array(*[F.lit(x) for x in TYPES])
    apart = ride.union(kept.where(~own).select(*link)).select("src", "dst", F.col("w").cast("int").alias("w"), F.get(names, "type").alias("etype"))
    return apart.union(least_edges(stay.union(kept.where(own).select(*link))))


def repair(path: str, gone: DataFrame, come: DataFrame, walks: DataFrame) -> list:
    """Bring the links under ``path`` up to date with connections that go and come.

    Returns the partitions ``(slot, area)`` that were written.  Running it again with the same
    connections changes nothing, so a repair that was cut off can be repeated.  Readers should
    be done with the partitions that are replaced.
    """
    spark = gone.sparkSession
    asks = written(_questions(come, walks), "come")
    left = written(_questions(gone, walks), "gone")
    both = asks.union(left)
    own = {tuple(r) for r in both.select("slot", "area").distinct().collect()}  # slots of the day times areas at most
    if not own:
        discard(asks, left)
        return []
    areas = sorted({area for _, area in own})
    held = read_departures(spark, path).where(F.col("area").isin(areas))
    there, away = _leaving(asks).withColumnRenamed("leave", "there"), _leaving(left).withColumnRenamed("leave", "away")
    none = F.array().cast("array<long>")
    lists = held.join(there, ["stop", "slot"], "full").join(away, ["stop", "slot"], "full")
    stays = F.array_union(F.array_except(F.coalesce("leave", none), F.coalesce("away", none)), F.coalesce("there", none))
    changed = F.col("there").isNotNull() | F.col("away").isNotNull()
    lists = lists.select("stop", "slot", F.array_sort(stays).alias("leave"), changed.alias("changed"), _area())
    _put(lists, f"{path}/departures", ["area"], [(a,) for a in areas])
    lists = spark.read.schema(f"{DEPARTURES}, changed boolean").parquet(f"{path}/departures").where(F.col("area").isin(areas))

    # back to the last slot before that has a departure, or to the first slot of all
    low = min(x for x in (read(spark, path).agg(F.min("slot")).first()[0], min(slot for slot, _ in own)) if x is not None)
    before = Window.partitionBy("stop").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    since = F.coalesce(F.last(F.when(F.size("leave") > 0, F.col("slot")), ignorenulls=True).over(before), F.lit(low))
    reach = lists.withColumn("since", since).where("changed").select("area", "since", "slot").distinct()
    back = reach.select(F.explode(F.sequence("since", "slot")).alias("slot"), "area").distinct().collect()
    parts = sorted(own | {tuple(r) for r in back})

    some = F.broadcast(spark.createDataFrame(parts, "slot int, area int"))
    one = lambda rows, rank: rows.select("slot", "area", _stop(), F.array(_item()).alias("items"), F.array("event").alias("events"), F.lit(rank).alias("rank"))
    old = read(spark, path).where(F.col("area").isin(areas) & F.col("slot").isin(sorted({slot for slot, _ in parts})))
    old = old.join(some, ["slot", "area"], "left_semi").select("slot", "area", "stop", "items", "events", F.lit(0).alias("rank"))
    ends = _beyond(lists, low).join(some, ["slot", "area"], "left_semi").select("slot", "area", "stop", F.array("item").alias("items"), F.array("event").alias("events"), F.lit(0).alias("rank"))
    rows = old.union(ends).union(one(asks, 1)).union(one(left, 2)).repartition("slot", "area")
    rows = rows.select("slot", "area", "stop", "rank", F.inline(F.arrays_zip("items", "events")).alias("item", "event"))
    # of equal questions those that go come first, then those that come, then the one held
    order = Window.partitionBy("slot", "area", "stop").orderBy(F.desc("item"), F.desc("event"), F.desc("rank"))
    rows = rows.withColumns({"i": F.lag("item").over(order), "e": F.lag("event").over(order)})
    again = F.coalesce((F.col("i") == F.col("item")) & (F.col("e") == F.col("event")), F.lit(False))
    rows = rows.where((F.col("rank") == 1) | ((F.col("rank") == 0) & ~again))
    _put(_answered(rows.select("slot", "area", "stop", "item", "event")), f"{path}/links", ["slot", "area"], parts)
    discard(asks, left)
    return parts
