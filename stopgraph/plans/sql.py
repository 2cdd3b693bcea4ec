"""SQL for an independent engine: the same timetable as common table expressions."""

from __future__ import annotations

ST = """st0 as (select l_orderkey, l_suppkey, l_returnflag, l_linenumber % 3 as dwell, row_number() over (o) - 1 as seq,
  (l_orderkey * 37) % 600 + sum(3 + l_partkey % 8 + l_linenumber % 3) over (o) - l_linenumber % 3 as arr
  from lineitem window o as (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey)),
st as (select cast(l_orderkey as integer) as trip, cast(seq as integer) as seq, cast(l_suppkey as integer) as stop,
  cast(case when l_orderkey % 23 = 5 and seq = 2 then null else arr end as integer) as arr, cast(case when l_orderkey % 23 = 5 and seq = 2 then null else arr + dwell end as integer) as dep,
  cast(l_orderkey % 50 as integer) as route_int, cast(case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as integer) as mode from st0)"""

CONN = """conn as materialized (select trip, seq, stop as from_stop, to_stop, dep, narr as arr, route_int, mode from
  (select *, lead(stop) over (w) as to_stop, lead(arr) over (w) as narr from st window w as (partition by trip order by seq))
  where to_stop is not null and stop <> to_stop and dep >= 0 and dep < 780 and narr >= 0 and narr <= 780)"""

LEGS = """legs as (select cast(a.s_suppkey as integer) as u, cast(b.s_suppkey as integer) as v, cast(4 + 3 * abs(a.s_suppkey - b.s_suppkey) as integer) as w
  from supplier a join supplier b on b.s_suppkey between a.s_suppkey - 2 and a.s_suppkey + 2 and a.s_suppkey <> b.s_suppkey)"""


def closure(cap: int, name: str = "walks") -> str:
    """The closure of the legs, unrolled as often as the cap allows."""
    out = [f"{name}_1 as (select * from legs where w <= {cap})"]
    k = 1
    for k in range(2, max(2, cap // 7 + 1)):
        out.append(f"{name}_{k} as (select u, v, min(w) as w from (select * from {name}_{k - 1} union all select a.u, b.v, a.w + b.w from {name}_{k - 1} a join legs b on a.v = b.u where a.w + b.w <= {cap} and a.u <> b.v) group by u, v)")
    return ",\n".join([*out, f"{name} as materialized (select u, v, cast(w as integer) as w from {name}_{k})"])


OD = """n as (select count(*) as n from supplier),
od as (select cast(q as integer) as q_id, cast(q * 13 % n as integer) as src, cast((q * 29 + 7) % n as integer) as dst, cast(60 + q * 17 % 300 as integer) as t_dep from range(20) t(q), n)"""

BASE = ",\n".join([ST, CONN, LEGS, closure(15), OD])


def rounds(k: int, conn: str = "conn", walks: str = "walks", od: str = "od", tag: str = "l") -> str:
    """Labels ``tag(q_id, stop, t)`` after ``k`` boardings."""
    out = [f"{tag}_0 as (select q_id, stop, min(t) as t from (select q_id, src as stop, t_dep as t from {od} union all select q_id, v, t_dep + w from {od} join {walks} on src = u) group by all)"]
    for i in range(1, k + 1):
        out += [
            f"{tag}_b{i} as (select q_id, trip, min(seq) as board from {tag}_{i - 1} join {conn} on stop = from_stop and dep >= t group by all)",
            f"{tag}_r{i} as materialized (select q_id, to_stop as stop, min(arr) as t from {tag}_b{i} b join {conn} c on b.trip = c.trip and seq >= board group by all)",
            f"{tag}_{i} as materialized (select q_id, stop, min(t) as t from (select * from {tag}_{i - 1} union all select * from {tag}_r{i} union all select q_id, v, t + w from {tag}_r{i} join {walks} on stop = u) group by all)",
        ]
    return ",\n".join([*out, f"{tag} as (select * from {tag}_{k})"])


def arrivals(tag: str = "l", od: str = "od") -> str:
    return f"select o.q_id, src, dst, t_dep, cast(t as integer) as ea from {od} o left join {tag} x on x.q_id = o.q_id and x.stop = dst"


def ask(select: str, *more: str) -> str:
    return "with " + ",\n".join([BASE, *more]) + "\n" + select


def draw(seed: int, *parts: str) -> str:
    return f"(cast('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(parts) + "), 1, 8) as bigint) / 4294967296.0)"
