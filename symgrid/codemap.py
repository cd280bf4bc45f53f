"""The tables of a code map, and where they come from."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schema import SCHEMAS


@dataclass
class CodeMap:
    """Tables by name (see ``schema``); one that is not given is empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fixed: set[str] = field(default_factory=set)
    derive_refs: bool = False
    derived: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def fix(self, *names: str) -> None:
        """Checkpoints tables that several analyses read, so that each is made once."""
        from .plans.storage import cut

        for name in set(names) - self.fixed:
            self.tables[name] = cut(getattr(self, name))
            self.fixed.add(name)


#: SQL that both engines run: the driver's tables read as a code map. Suppliers are files, parts are
#: functions, line items are calls, orders are imports, events are annotations.
TABLE_SQL = {
    "sizes": "select (select count(*) from supplier) as nf, cast(floor((select count(*) from part) / 3.0) as bigint) as nn",
    "files": """select s_suppkey as file_id, case
  when s_suppkey % 7 = 0 then concat('svc', s_suppkey % 5, '/tests/t', s_suppkey, '.', ext)
  when s_suppkey % 11 = 0 then concat('svc', s_suppkey % 5, '/mod', s_suppkey % 4, '/index.', ext)
  else concat('svc', s_suppkey % 5, '/mod', s_suppkey % 4, '/m', s_suppkey, '.', ext) end as path, language, family, is_typed, package_scoped, cast(4000 as int) as lines
from (select s_suppkey, case s_suppkey % 6 when 0 then 'rs' when 1 then 'py' when 2 then 'ts' when 3 then 'go' when 4 then 'cpp' else 'cs' end as ext,
  case s_suppkey % 6 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' when 3 then 'go' when 4 then 'cpp' else 'csharp' end as language,
  case s_suppkey % 6 when 0 then 'rust' when 1 then 'python' when 2 then 'js' when 3 then 'go' when 4 then 'c' else 'csharp' end as family,
  s_suppkey % 6 <> 1 as is_typed, s_suppkey % 6 in (3, 4, 5) as package_scoped from supplier) s""",
    "funcs": """select file_id, ord, file_id * 100000 + ord as node_id, cast(ord * 40 + 2 as int) as line, name, ret, cast(ord * 40 + 2 as int) as start_line, cast(ord * 40 + 2 + p_size % 35 as int) as end_line, p_partkey % 29 = 0 as test_ctx,
  owner, cast(p_size * 3 as int) as body_lines, cast(p_size % 8 as int) as params, cast(p_partkey % 19 as int) as branches, p_partkey % 17 = 0 as recursive, p_partkey
from (select p_partkey, p_size, 1 + p_partkey % nf as file_id, cast(row_number() over (partition by 1 + p_partkey % nf order by p_partkey) - 1 as int) as ord,
  case when p_partkey % 13 = 0 then concat('test_f', p_partkey % nn) else concat('f', p_partkey % nn) end as name,
  case p_partkey % 4 when 0 then 'Result<T3, Error>' when 1 then concat('Option<T', p_partkey % 60, '>') when 2 then concat('T', p_partkey % 60) end as ret,
  case when p_partkey % 5 = 0 then concat('T', p_partkey % 60) end as owner from part cross join sizes) p""",
    "loops": """select f.node_id, cast(f.start_line + l.k as int) as line, case l.k when 1 then 'for' else 'while' end as kind, cast(l.k as int) as depth, case when (p_partkey + l.k) % 3 = 0 then cast((p_partkey + l.k) % 12 as int) end as trip
from funcs f join (select r_regionkey + 1 as k from region) l on l.k <= p_partkey % 5""",
    "resources": """select f.node_id, cast(f.start_line + r.k as int) as line, case when r.k % 3 = 0 then release_name else acquire_name end as name, case when r.k % 3 = 0 then acquire_name else acquire_name end as pair, r.k % 3 <> 0 as acquire, (p_partkey + r.k) % 5 = 0 as guarded
from funcs f join files x on f.file_id = x.file_id join (select r_regionkey + 1 as k from region) r on r.k <= p_partkey % 4
join (select 'rust' as language, 'into_raw' as acquire_name, 'from_raw' as release_name union all select 'python', 'open', 'close' union all select 'typescript', 'setInterval', 'clearInterval' union all select 'go', 'Open', 'Close' union all select 'cpp', 'malloc', 'free' union all select 'csharp', 'Rent', 'Return') p on p.language = x.language""",
    "calls": """select f.file_id, case when l_linenumber = 5 and l_orderkey % 10 = 0 then '<top>' else f.name end as caller, cast(f.start_line + l_linenumber as int) as line, concat('f', (l_orderkey * 7 + l_linenumber) % (nn + 50)) as name,
  case l_suppkey % 5 when 0 then null when 1 then concat('m', l_suppkey) when 2 then 'std::fs' when 3 then concat('crate::mod', l_suppkey % 4) else concat('self.pkg', l_suppkey % 8) end as qualifier,
  case when l_linenumber = 6 then concat('T', l_suppkey % 80) end as recv_type, l_linenumber = 7 as test_ctx
from lineitem join funcs f on l_partkey = f.p_partkey cross join sizes""",
    "imports": """select 1 + o_custkey % nf as file_id, cast(o_orderkey % 200 as int) as line, case o_orderkey % 3 when 0 then concat('svc', o_orderkey % 5, '/mod', o_orderkey % 4, '/m', 1 + o_orderkey % nf) when 1 then concat('app.m', 1 + o_custkey % nf) else 'ext::lib' end as module,
  case when o_orderkey % 8 = 0 then '' else concat('f', o_orderkey % nn, ',f', o_custkey % nn) end as names_csv, o_orderkey % 9 = 0 as reexport from orders cross join sizes""",
    "types": "select distinct file_id, cast(1 as int) as line, owner as name, 'struct' as kind from funcs where owner is not null and p_partkey % 2 = 0",
    "modules": "select file_id, concat('pkg', file_id % 8) as name from files",
    "consts": "select 1 + c_custkey % nf as file_id, cast(c_custkey % 300 as int) as line, concat('K_', c_custkey % 700) as name, c_mktsegment as ty from customer cross join sizes",
    "notes": "select 1 + c_custkey % nf as file_id, cast(c_custkey % 500 as int) as line, concat(case c_custkey % 4 when 0 then 'TODO' when 1 then 'fixme(me)' when 2 then 'note' else 'HACK' end, ': look at ', c_name) as text from customer cross join sizes",
    "annotations": """select 1 + user_id % nf as file_id, cast(event_id % 3000 as int) as line, case when event_type in ('click', 'view') then 'serves' else 'calls' end as boundary,
  case event_id % 3 when 0 then 'queue' when 1 then 'http' else 'unspecified' end as transport, concat(case when event_id % 2 = 0 then ' Topic.' else 'topic.' end, event_id % 900) as key, concat('f', event_id % 100) as function from events cross join sizes""",
    "hunks": "select f.path, cast(n_nationkey * 37 + 1 as int) as start, cast(n_nationkey * 37 + 1 + n_nationkey % 9 as int) as stop from nation cross join sizes join files f on f.file_id = 1 + (n_nationkey * 3) % nf",
}
#: Service globs and declared dependencies used with the tables above.
SERVICES = {"svc0": ["svc0"], "svc1": ["svc1/**"], "svc2": ["svc2/mod?/*.*", "svc2/tests"], "svc3": ["svc3"], "shared": ["svc4/mod1", "svc3/mod1/**"]}
DEPS = {"svc0": ["svc3", "billing"], "svc1": ["svc2"]}


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_KNOWN: dict[tuple, CodeMap] = {}


def _stamp(sf_dir: str) -> tuple | None:
    """Time and size of the files; None where they can't be seen from here."""
    try:
        return tuple((x.st_mtime_ns, x.st_size) for x in (os.stat(f"{sf_dir}/{t}.parquet") for t in _TABLES))
    except OSError:
        return None


def forget() -> None:
    """Drops the maps that the session keeps."""
    _KNOWN.clear()


def from_tables(spark: SparkSession, sf_dir: str) -> CodeMap:
    """The driver's tables as a code map. The SQL above runs against their Parquet files.

    A session keeps the map of a folder, with what was derived from it, until the files change.
    """
    stamp = _stamp(sf_dir)
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, stamp)
    if stamp is not None and key in _KNOWN:
        return _KNOWN[key]
    tag, views = uuid.uuid4().hex[:8], {}
    for t in _TABLES:
        views[t] = f"{t}_{tag}"
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(views[t])
    out = {}
    names = [*views, *TABLE_SQL]
    for name, sql in TABLE_SQL.items():
        bound = re.sub(rf"\b(from|join) ({'|'.join(names)})\b", lambda m: f"{m[1]} {m[2]}_{tag}", sql)
        out[name] = spark.sql(bound)
        out[name].createOrReplaceTempView(f"{name}_{tag}")
    out["imports"] = out["imports"].withColumn("names", F.filter(F.split("names_csv", ","), lambda x: x != "")).drop("names_csv")
    out["funcs"] = out["funcs"].withColumns({"comment": F.lit(None).cast("string"), "col": F.lit(1), "nodes": F.lit(0), "param_types": F.array().cast("array<string>")})
    from .operators.calls import same_file_refs

    m = CodeMap(spark, out, derive_refs=True)
    m.tables["refs"] = same_file_refs(m)
    if stamp is not None:
        for old in [k for k in _KNOWN if k[:3] == key[:3]]:
            del _KNOWN[old]
        _KNOWN[key] = m
    return m
