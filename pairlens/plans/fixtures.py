"""Views over the given tables in the shapes of an evaluation run.

The texts run in Spark and in DuckDB; ``{orders}`` and so on stand for the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One row for each pair: prediction, truth and confidence features.
PAIRS = """
select o_orderkey as pair_id, c, grp, architecture, severity, case when grp='C' then 0 else 1 end as gt_found,
  100.0e0+(o_custkey*37%800) as gt_x, 100.0e0+(o_custkey*53%800) as gt_y,
  8.0e0+(c%401)/100.0e0 as gt_scale, -5.0e0+(c%1001)/100.0e0 as gt_rot,
  100.0e0+(o_custkey*37%800)+(d%97-48)/16.0e0*(case when d%11=0 then 32.0e0 else 1.0e0 end) as x,
  100.0e0+(o_custkey*53%800)+(d%89-44)/16.0e0 as y,
  (8.0e0+(c%401)/100.0e0)*(1.0e0+(d%13-6)/200.0e0) as scale,
  -5.0e0+(c%1001)/100.0e0+(d%17-8)/10.0e0 as theta,
  case when grp='C' then (d%512)/1024.0e0 else (d%768)/1024.0e0+0.25e0 end as score,
  (d%613)/1024.0e0 as zncc, (d%211)/256.0e0 as peak_ratio, (d%331)/512.0e0 as pose_peak,
  (d%2000)/1000.0e0 as secs, cast(d%7 as int) as n_hyp, case when d%29=0 then 1 else 0 end as failed
from (select o_orderkey, o_custkey, o_orderpriority as architecture, c, {d} as d, cast(c%5 as int) as severity,
        case when o_orderkey%25<9 then 'A' when o_orderkey%25<18 then 'B' when o_orderkey%25<23 then 'C' else 'D' end as grp
      from (select o_orderkey, o_custkey, o_orderpriority, cast(round(o_totalprice*100) as bigint) as c from {orders}) k) b
"""
V1 = PAIRS.replace("{d}", "c")
#: The same pairs in a second run.
V2 = PAIRS.replace("{d}", "(c*7+3)")
#: Several candidates for each pair.
V3 = """
select l_orderkey as pair_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 as hypothesis_index,
  (l_partkey%97)/8.0e0 as location_error, (l_suppkey%64)/64.0e0 as zncc, (l_partkey%128)/128.0e0 as rank_score,
  cast(l_quantity as int)%32/32.0e0 as band_score, (l_partkey*31%256)/256.0e0 as dog_score,
  cast(l_partkey%40 as double) as px, cast(l_suppkey%40 as double) as py
from {lineitem}
"""
#: Boxes of a layout.
V4 = """
select cast(p_size%8 as int) as layer, p_partkey as box_id, (p_partkey*17%1000)*1.0e0 as x0, (p_partkey*29%1000)*1.0e0 as y0,
  (p_partkey*17%1000)*1.0e0+p_size as x1, (p_partkey*29%1000)*1.0e0+p_size as y1
from {part}
"""
CLAIMED = "select doc_id, source, n_chars, md5(text) as sha from {documents} where doc_id%7<>0"
PRESENT = "select doc_id, source, n_chars, case when doc_id%11=0 then md5(concat(text, 'x')) else md5(text) end as sha from {documents} where doc_id%5<>0"
VIEWS = {"v1": V1, "v2": V2, "v3": V3, "v4": V4, "claimed": CLAIMED, "present_files": PRESENT}


#: Views that sort within a key of a table, and rows that one task sorts at most (a key's rows stay together).
SORTED, AT_ONCE = {"v3": ("lineitem", "l_orderkey")}, 300_000


def spread(table: DataFrame, key: str) -> DataFrame:
    """The table dealt by a key to as many tasks as its rows need; as it is if the session's own number does."""
    most = table.count() // AT_ONCE + 1  # by the files' footers
    return table.repartition(most, key) if most > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of this file or a table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    tables = {t: view(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if name in SORTED:
        table, key = SORTED[name]
        tables[table] = spread(tables[table], key)
    return spark.sql(text.format_map({t: "{" + t + "}" for t in TABLES}), **tables)


def with_views(sql: str) -> str:
    """The SQL with the views it names in front, for DuckDB."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} as ({VIEWS[n].format_map({t: t for t in TABLES})})" for n in used)
    body = sql.strip()
    if not used:
        return body
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"with {ctes} {body}"


class Queries(dict):
    """name -> query; ``sql`` has the SQL of those that SQL can express."""

    def __init__(self):
        super().__init__()
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, reads: str = ""):
        """Registers ``f(views...) -> DataFrame``; reads names the views that f gets, in order."""

        def put(f):
            self[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in reads.split()))
            if sql:
                self.sql[name] = with_views(sql)
            return f

        return put
