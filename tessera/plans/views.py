"""Geometry views over the star-schema tables; the SQL of a view is the same in Spark and DuckDB unless two texts are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "CAST({} AS DOUBLE)"


def _d(e: str, name: str) -> str:
    return f"CAST({e} AS DOUBLE) AS {name}"


def _sheet(e: str, n: int) -> str:
    return f"CAST(FLOOR({e} / {n}) AS BIGINT) AS sheet"


#: view: (tables, SQL or (Spark SQL, DuckDB SQL)).
VIEWS: dict[str, tuple[tuple[str, ...], str | tuple[str, str]]] = {
    "g_rect": (("part",), f"select p_partkey as id, {_sheet('p_partkey', 2000)}, {_d('(p_partkey * 37) % 1000', 'x_min')}, {_d('(p_partkey * 91) % 1000', 'y_min')}, {_d('(p_partkey * 37) % 1000 + p_size', 'x_max')}, {_d('(p_partkey * 91) % 1000 + 1 + p_partkey % 17', 'y_max')}, CAST(p_partkey % 10 AS INT) as quality, CAST(p_partkey % 3 AS INT) as kind, CAST(p_size AS INT) as size, p_brand as brand from part"),
    "g_circle": (("customer",), f"select c_custkey as id, {_sheet('c_custkey', 2000)}, {_d('(c_custkey * 53) % 1000', 'cx')}, {_d('(c_custkey * 29) % 1000', 'cy')}, {_d('1 + c_custkey % 13', 'r')} from customer"),
    "g_edge": (("orders",), f"select o_orderkey as id, {_sheet('o_orderkey', 2000)}, {_d('(o_orderkey * 17) % 1000', 'x1')}, {_d('(o_orderkey * 71) % 1000', 'y1')}, {_d('(o_orderkey * 17) % 1000 + 1 + o_custkey % 40', 'x2')}, {_d('(o_orderkey * 71) % 1000 + (o_orderkey % 41) - 20', 'y2')}, o_custkey as cust from orders"),
    "g_point": (("events",), f"select event_id as id, {_sheet('event_id', 5000)}, {_d('(event_id * 7919) % 1000', 'x')}, {_d('(event_id * 104729) % 1000', 'y')} from events"),
    "g_poly": (("embeddings",), (
        f"select vec_id as id, {_sheet('vec_id', 500)}, transform(sequence(0, 11), k -> named_struct('x', round((vec_id * 61) % 1000 + (10 + 40 * abs(CAST(embedding[k] AS DOUBLE))) * cos(2 * pi() * k / 12), 4) + CAST(0 AS DOUBLE), 'y', round((vec_id * 17) % 1000 + (10 + 40 * abs(CAST(embedding[k] AS DOUBLE))) * sin(2 * pi() * k / 12), 4) + CAST(0 AS DOUBLE))) as ring from embeddings",
        f"select vec_id as id, {_sheet('vec_id', 500)}, list_transform(range(0, 12), lambda k: {{'x': round((vec_id * 61) % 1000 + (10 + 40 * abs(embedding[k + 1]::DOUBLE)) * cos(2 * pi() * k / 12), 4) + CAST(0 AS DOUBLE), 'y': round((vec_id * 17) % 1000 + (10 + 40 * abs(embedding[k + 1]::DOUBLE)) * sin(2 * pi() * k / 12), 4) + CAST(0 AS DOUBLE)}}) as ring from embeddings",
    )),
    "g_item": (("part", "lineitem"), "select p_partkey as id, CAST(p_size AS DOUBLE) as w, CAST(1 + p_partkey % 17 AS DOUBLE) as h, CAST(coalesce(d, 0) AS BIGINT) as demand, CAST(p_partkey % 4 AS INT) as grain, CAST(1 + p_partkey % 9 AS BIGINT) as min_quality from part left join (select l_partkey, sum(l_quantity) as d from lineitem group by l_partkey) q on l_partkey = p_partkey"),
    "g_bin": (("supplier",), "select s_suppkey as id, CAST(100 + (s_suppkey * 7) % 400 AS DOUBLE) as w, CAST(100 + (s_suppkey * 13) % 300 AS DOUBLE) as h, CAST(1 + s_suppkey % 5 AS BIGINT) as stock, CAST(10 + s_suppkey % 90 AS BIGINT) as cost from supplier"),
    "g_placement": (("lineitem", "part"), f"select l_orderkey as sheet, l_orderkey * 100 + l_linenumber as id, l_partkey as item, {_d('(l_linenumber - 1) * 40', 'x_min')}, {_d('(l_partkey * 7) % 30', 'y_min')}, {_d('(l_linenumber - 1) * 40 + p_size', 'x_max')}, {_d('(l_partkey * 7) % 30 + 1 + l_partkey % 17', 'y_max')}, CAST((l_linenumber % 4) * 90 AS INT) as rot, l_suppkey as bin from lineitem join part on l_partkey = p_partkey"),
    "g_offset": (("events",), "select CAST(user_id % 3 AS BIGINT) as part, row_number() over (partition by user_id % 3 order by event_id) - 1 as pos, (event_id * 2654435761) % 100 < 98 as done, event_id from events"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = sql if isinstance(sql, str) else sql[0]
    return spark.sql(" ".join(_bound(text, tables)), **read)


def _bound(text: str, tables: tuple[str, ...]) -> list[str]:
    """The names of tables, after from or join, as parameters of spark.sql."""
    words = text.split(" ")
    return [f"{{{w.strip(')')}}}{')' * w.count(')')}" if w.strip(")") in tables and words[i - 1] in ("from", "join") else w.replace("{", "{{").replace("}", "}}") for i, w in enumerate(words)]


def ctes(*names: str) -> str:
    """WITH clause of the views for DuckDB."""
    return "with " + ", ".join(f"{n} as ({s if isinstance(s := VIEWS[n][1], str) else s[1]})" for n in names)
