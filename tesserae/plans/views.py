"""The test tables seen as rasters, volumes, point sets and graphs; the same definitions as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, select list); the text is valid in Spark SQL and in DuckDB.
VIEWS = {
    "img": (
        "orders",
        "CAST(floor(o_orderkey / 125.0) AS BIGINT) AS y, o_orderkey % 125 AS x, o_totalprice AS raw, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE ascii(o_orderstatus) END AS cls, "
        "CAST(1 + floor(o_totalprice / 50000) AS BIGINT) AS gt, CAST((floor(floor(o_orderkey / 125.0) / 8) * 16 + floor((o_orderkey % 125) / 8.0)) * 3 AS BIGINT) + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS seg",
    ),
    "vol": (
        "orders",
        "CAST(floor(o_orderkey / 500.0) AS BIGINT) AS z, CAST(floor(o_orderkey / 25.0) AS BIGINT) % 20 AS y, o_orderkey % 25 AS x, o_totalprice AS raw, "
        "CAST(CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 + 2 * (floor(CAST(floor(o_orderkey / 25.0) AS BIGINT) % 20 / 5.0) * 5 + floor((o_orderkey % 25) / 5.0)) + CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END END AS BIGINT) AS label",
    ),
    "ev_img": ("events", "CAST(floor(event_id / 100.0) AS BIGINT) AS y, event_id % 100 AS x, value AS raw, user_id % 40 AS seg, event_type <> 'error' AS mask, event_type AS well"),
    "emb": ("embeddings", "CAST(floor(vec_id / 25.0) AS BIGINT) AS y, vec_id % 25 AS x, embedding, CAST(label AS BIGINT) AS label"),
    "pts": ("lineitem", "l_orderkey * 8 + l_linenumber AS pid, l_partkey % 125 AS x, l_suppkey % 100 AS y"),
    "signed": ("lineitem", "l_suppkey AS u, l_partkey % 100 + 1000 AS v, l_discount - 0.05 AS w"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions."""
    import re

    used = [k for k in VIEWS if re.search(rf"\b{k}\b", sql)]
    ctes = ", ".join(f"{k} AS (SELECT {VIEWS[k][1]} FROM {VIEWS[k][0]})" for k in used)
    head = "WITH RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else None
    return f"{head}{ctes}, {body}" if body is not None else f"{head}{ctes} {sql}" if ctes else sql
