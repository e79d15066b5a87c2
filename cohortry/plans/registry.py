"""Query catalogue: name -> (Spark callable, oracle SQL). Filled by the q_*.py modules on import."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def oracle(views: Sequence[str], body: str, ctes: str = "") -> str:
    """Oracle text: the role views it needs, extra CTEs, then the query."""
    from .views import SQL_VIEWS, VIEW_NEEDS

    order: list[str] = []

    def need(v: str) -> None:
        for d in VIEW_NEEDS.get(v, ()):
            need(d)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in order]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body.strip()


def auc_sql(src: str, by: str, y: str = "label", s: str = "score", n: bool = True, extra: str = "", digits: int | None = 6) -> str:
    """Rank-sum AUC over `src` (independent of the compressed-count form the engine uses)."""
    over = f"partition by {by} " if by else ""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    ratio = "(r1 - n1*(n1+1)/2.0::double)/(n1::double*n0::double)"
    value = ratio if digits is None else f"round({ratio}, {digits})"
    counts = "cast(n1 as bigint) as n1, cast(n0 as bigint) as n0, " if n else ""
    return f"""
select {keys}{counts}case when n1 > 0 and n0 > 0 then {value} end as auc{extra}
from (select {keys}sum(case when {y}=1 then 1 else 0 end) as n1, sum(case when {y}=0 then 1 else 0 end) as n0,
             sum(case when {y}=1 then rk else 0.0::double end) as r1
      from (select *, rank() over ({over}order by {s})::double + (count(*) over (partition by {keys}{s}) - 1)/2.0::double as rk
            from {src} where {s} is not null) {group})"""
