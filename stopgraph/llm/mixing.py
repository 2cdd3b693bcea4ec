"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Weights are given for each level of a tree (domain, language, source).  A node's budget is
dealt to its children in proportion to their weights; a child that cannot use its share
keeps what its rows hold (times the epochs allowed) and the rest goes to its siblings.
Because a node never gets more than its subtree can hold, shortages are made up among
siblings first and reach an ancestor only when all of them are full.

Each leaf then takes whole epochs of its rows and, of one more epoch in a seeded order, the
prefix that fits.  The prefix is found from sums of hash buckets, so only one bucket of a
leaf is ever sorted: neither a leaf with a third of all rows nor its texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Rows of a hash bucket, about; leaves up to which their table is broadcast.
BUCKET_ROWS, MOST_BROADCAST = 4096, 50_000


def estimated_tokens(text: str = "text") -> Column:
    """A token for every four bytes, one at least where there is text."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text)) / F.lit(4)).cast("long"), F.lit(0).cast("long"))


def _deal(children: DataFrame, parents: DataFrame, above: list[str], own: str) -> DataFrame:
    """Deal each parent's ``budget`` to its ``children(above, own, weight, room)``."""
    # the root has one row of parents
    both = children.join(parents, above) if above else children.withColumn("root", F.lit(0)).join(parents.withColumn("root", F.lit(0)), "root")
    live = both.where("weight > 0")
    order = Window.partitionBy(*above).orderBy(F.col("room").cast("double") / F.col("weight").cast("double"), own)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*above)
    live = (
        live.withColumn("turn", F.row_number().over(order))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("short", F.col("room") * F.col("share") <= F.col("left") * F.col("weight"))
        .withColumn("first", F.min(F.when(~F.col("short"), F.col("turn"))).over(whole))
        .withColumn("rest", F.max(F.when(F.col("turn") == F.col("first"), F.col("left"))).over(whole))
        .withColumn("over", F.max(F.when(F.col("turn") == F.col("first"), F.col("share"))).over(whole))
    )
    dealt = F.when(F.col("first").isNull() | (F.col("turn") < F.col("first")), F.col("room")).otherwise(F.expr("rest * weight div over"))
    return live.select(*above, own, dealt.alias("budget"))


def budgets(leaves: DataFrame, path: list[str], weights: list[Column], budget: Column, max_epochs: int) -> DataFrame:
    """Each leaf's budget in tokens, of ``leaves(path..., tokens)``.

    ``weights`` has a whole-number expression over the path's columns for each level, not
    negative; ``budget`` is an aggregate over the leaves' tokens or a literal.  Rounding
    down leaves at most a token a node unspent.
    """
    room = leaves.withColumn("room", F.col("tokens") * max_epochs)
    dealt = room.agg(F.least(budget, F.sum("room")).cast("long").alias("budget")).where("budget is not null")
    for k, own in enumerate(path):
        level = room.groupBy(*path[: k + 1]).agg(F.sum("room").cast("long").alias("room"))
        level = level.withColumn("weight", F.coalesce(weights[k].cast("long"), F.lit(0)))
        dealt = _deal(level, dealt, path[:k], own)
    return dealt


def mix(spark: SparkSession, docs: DataFrame, path: dict[str, Column], weights: list[Column], budget: Column, max_epochs: int, seed: int, tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` as mixed: each row as often as it was drawn, with ``mix_epoch`` and ``mix_tokens``.

    ``path`` names the tree's levels and how a row gives them; nulls count as ''.  In the
    partial epoch rows are ordered by md5 of seed, epoch and id, ties by id and tokens, and
    drawn up to the last that fits whole.  Rows without tokens (null or empty texts) are
    never drawn; a row of null id is ordered by an empty id; repeated rows are drawn each on
    its own; a weight that is null or 0 shuts its subtree out; other columns pass through, but
    any that is named as the two added ones is replaced; an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    names = [f"mix_{n}" for n in path]
    # a row travels as a struct, so none of its columns' names can clash with those made here
    here = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_epoch", "mix_tokens")]).alias("mix_row"),
        F.col(id_col).alias("mix_id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(f"mix_{n}") for n, c in path.items()],
        (estimated_tokens() if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("mix_tokens"),
    ).where("mix_tokens > 0")
    leaves = here.groupBy(*names).agg(F.count("*").alias("n"), F.sum("mix_tokens").alias("tokens"))
    leaves = scratch.table(leaves.withColumnsRenamed(dict(zip(names, path, strict=True))), "leaves")
    dealt = budgets(leaves, [*path], weights, budget, max_epochs).join(leaves, [*path]).where("budget > 0")
    dealt = dealt.selectExpr(*path, "budget div tokens as full", "budget % tokens as rest", f"cast(ceil(n / {BUCKET_ROWS}) as bigint) as buckets")
    dealt = scratch.table(dealt.withColumnsRenamed(dict(zip(path, names, strict=True))), "budgets")

    def near(leaf: DataFrame) -> DataFrame:
        """The leaves' table to join: broadcast while its size is known to be small."""
        return F.broadcast(leaf) if few else leaf

    few = dealt.count() <= MOST_BROADCAST

    def ordered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("mix_id").cast("string"), F.lit(""))).cast("binary")))
        return rows.withColumn("mix_bucket", F.expr("cast(conv(substring(mix_key, 1, 8), 16, 10) as bigint) * buckets div 4294967296"))

    placed = ordered(here.join(near(dealt), names))
    sums = placed.where("rest > 0").groupBy(*names, "mix_bucket").agg(F.sum("mix_tokens").alias("own"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy(*names).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("own").over(up_to))
    # the first bucket that does not fit whole, and what is left when it begins
    edge = sums.where("end > rest").groupBy(*names).agg(F.min(F.struct("mix_bucket", (F.col("rest") - F.col("end") + F.col("own")).alias("fits"))).alias("edge")).select(*names, F.col("edge.mix_bucket").alias("edge"), "edge.fits")
    dealt = scratch.table(dealt.join(edge, names, "left"), "edges")

    placed = ordered(here.join(near(dealt), names))
    # rest < tokens, so a leaf with a rest has an edge
    sure = F.when((F.col("rest") > 0) & (F.col("mix_bucket") < F.col("edge")), F.col("full")).otherwise(F.col("full") - 1)
    columns = ["mix_row.*", "mix_epoch", "mix_tokens"]
    whole = placed.where(sure >= 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), sure))).withColumn("mix_epoch", F.col("mix_epoch").cast("int")).select(*columns)
    in_edge = Window.partitionBy(*names).orderBy("mix_key", "mix_id", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = placed.where("rest > 0 and mix_bucket = edge").withColumn("mix_end", F.sum("mix_tokens").over(in_edge)).where("mix_end <= fits")
    return whole.unionByName(part.withColumn("mix_epoch", F.col("full").cast("int")).select(*columns))


#: The tree and weights of the registered query and of the pipeline.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def document_path() -> dict[str, Column]:
    """Domain (from the source's number), language and source of ``documents``."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint)")
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def document_weights() -> list[Column]:
    def of(column: str, table: dict[str, int]) -> Column:
        out = F.lit(1)
        for k, w in table.items():
            out = F.when(F.col(column) == k, w).otherwise(out)
        return out

    return [of("domain", DOMAIN_WEIGHTS), of("lang", LANG_WEIGHTS), F.lit(1)]


def document_sql(percent: int, max_epochs: int, seed: int, table: str = "documents") -> str:
    """The same mix as DuckDB SQL: ``doc_id, domain, lang, source, mix_epoch, mix_tokens``."""

    def case(column: str, weights: dict[str, int]) -> str:
        return f"case {column} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + " else 1 end"

    ctes = [
        f"""here as (select doc_id, coalesce('d' || cast(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint) % 4 as varchar), '') as domain,
            coalesce(lang, '') as lang, coalesce(source, '') as source, cast(ceil(strlen(text) / 4.0) as bigint) as tokens
          from {table} where strlen(text) > 0)""",
        "leaves as (select domain, lang, source, cast(sum(tokens) as bigint) as tokens from here group by all)",
        f"budget_0 as (select least(cast(sum(tokens) as bigint) * {percent} // 100, cast(sum(tokens) as bigint) * {max_epochs}) as budget from leaves)",
    ]
    path, weights = ["domain", "lang", "source"], [case("domain", DOMAIN_WEIGHTS), case("lang", LANG_WEIGHTS), "1"]
    for k, own in enumerate(path):
        above = ", ".join(path[:k])
        keys = ", ".join(path[: k + 1])
        over = f"partition by {above} " if above else ""
        join = f"join budget_{k} using ({above})" if above else f"cross join budget_{k}"
        ctes += [
            f"room_{k} as (select {keys}, cast(sum(tokens) as bigint) * {max_epochs} as room, {weights[k]} as weight from leaves group by all)",
            f"""turn_{k} as (select *, row_number() over (w) as turn,
                budget - coalesce(cast(sum(room) over (w rows between unbounded preceding and 1 preceding) as bigint), 0) as rem,
                cast(sum(weight) over ({over}) as bigint) - coalesce(cast(sum(weight) over (w rows between unbounded preceding and 1 preceding) as bigint), 0) as share
              from room_{k} {join} where weight > 0 window w as ({over}order by cast(room as double) / cast(weight as double), {own}))""",
            f"first_{k} as (select *, min(case when room * share > rem * weight then turn end) over ({over}) as first from turn_{k})",
            f"""rest_{k} as (select *, max(case when turn = first then rem end) over ({over}) as rest,
                max(case when turn = first then share end) over ({over}) as total from first_{k})""",
            f"budget_{k + 1} as (select {keys}, case when first is null or turn < first then room else rest * weight // total end as budget from rest_{k})",
        ]
    ctes += [
        "dealt as (select domain, lang, source, budget // tokens as full_epochs, budget % tokens as rest from budget_3 join leaves using (domain, lang, source) where budget > 0)",
        f"""drawn as (select here.*, full_epochs, rest, sum(tokens) over (partition by domain, lang, source
              order by md5('{seed}:' || full_epochs || ':' || doc_id), doc_id, tokens rows unbounded preceding) as upto
            from here join dealt using (domain, lang, source))""",
        "epochs as (select *, unnest(range(0, full_epochs + case when upto <= rest then 1 else 0 end)) as epoch from drawn)",
    ]
    return "with " + ",\n".join(ctes) + "\nselect doc_id, domain, lang, source, cast(epoch as integer) as mix_epoch, tokens as mix_tokens from epochs"


def documents_mixed(spark: SparkSession, docs: DataFrame, percent: int, max_epochs: int, seed: int) -> DataFrame:
    """``documents`` mixed to ``percent`` of their tokens by the tree above."""
    return mix(spark, docs, document_path(), document_weights(), F.expr(f"sum(tokens) * {percent} div 100"), max_epochs, seed)
