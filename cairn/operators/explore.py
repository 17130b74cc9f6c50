"""A trace index asked by a specification: filters, facets, order, pages; as URL parameters and back."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 60


@dataclass(frozen=True)
class QuerySpec:
    env: tuple[str, ...] = ()
    model: tuple[str, ...] = ()
    outcome: str = ""
    least_rate: float | None = None
    most_rate: float | None = None
    least_jump: float | None = None
    least_probes: int | None = None
    search: str = ""
    order: str = "jump"
    descending: bool = True
    page: int = 0

    def to_url(self) -> str:
        plain = QuerySpec()
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if v != getattr(plain, f.name):
                out[f.name] = ",".join(v) if isinstance(v, tuple) else int(v) if isinstance(v, bool) else v
        return urlencode(out)

    @staticmethod
    def from_url(query: str) -> "QuerySpec":
        kinds = {"env": lambda s: tuple(x for x in s.split(",") if x), "least_rate": float, "most_rate": float, "least_jump": float, "least_probes": int, "descending": lambda s: s == "1", "page": int}
        kinds["model"] = kinds["env"]
        known = {f.name for f in fields(QuerySpec)}
        return replace(QuerySpec(), **{k: kinds.get(k, str)(v) for k, v in parse_qsl(query) if k in known})


def matching(index: DataFrame, q: QuerySpec, text: tuple[str, ...] = ("trace",)) -> DataFrame:
    """Rows of the index (env, model, r1, jump, np) that meet all that is asked; each filter reaches the scan."""
    tests = [
        (q.env, F.col("env").isin(list(q.env))),
        (q.model, F.col("model").isin(list(q.model))),
        (q.outcome == "deceptive", F.col("r1") >= 0.5),
        (q.outcome == "honest", F.col("r1") < 0.5),
        (q.least_rate is not None, F.col("r1") >= F.lit(q.least_rate)),
        (q.most_rate is not None, F.col("r1") <= F.lit(q.most_rate)),
        (q.least_jump is not None, F.abs(F.col("jump")) >= F.lit(q.least_jump)),
        (q.least_probes is not None, F.col("np") >= F.lit(q.least_probes)),
        (q.search, F.lower(F.concat_ws(" ", *text)).contains(q.search.lower())),
    ]
    for asked, test in tests:
        if asked:
            index = index.where(test)
    return index


def page(rows: DataFrame, q: QuerySpec, identity: str = "trace", size: int = PAGE) -> DataFrame:
    """One page in order, ties by id."""
    first = F.desc_nulls_last(q.order) if q.descending else F.asc_nulls_last(q.order)
    return rows.orderBy(first, F.asc(identity)).offset(q.page * size).limit(size)


def facets(index: DataFrame) -> DataFrame:
    """Counts by environment, model and outcome, in one pass."""
    outcome = F.when(F.col("r1") >= 0.5, "deceptive").otherwise("honest")
    long = index.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in (("env", F.col("env")), ("model", F.col("model")), ("outcome", outcome))])).alias("f"))
    return long.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
