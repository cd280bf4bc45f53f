"""Queries over the driver's tables read as a code map, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..codemap import DEPS, SERVICES, from_tables
from ..functions import scalars as S
from ..operators import calls as C, coverage as T, graph as G, lookup as L, metrics as M, report as P, resolve as R, search, services as V, spans
from ..oracle import build
from ..schema import extensions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):  # noqa: ANN201
    """Registers a function of a code map (and the session and folder, if it asks for them)."""

    def wrap(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, d: f(from_tables(spark, d))
        if sql:
            SQL[f.__name__] = build(sql, **parts)
        return f

    return wrap


@query("select node_id, file_id, name, is_module from nodes")
def graph_nodes(m):  # noqa: ANN001, ANN201
    return C.nodes(m)


@query("select file_id, alias from aliases")
def file_aliases(m):  # noqa: ANN001, ANN201
    return C.file_aliases(m)


@query("select file_id, name, target from imported")
def imported_names(m):  # noqa: ANN001, ANN201
    return C.imported_names(m)


@query("select file_id, caller, call_line, target_line, target_name, target_ret from refs")
def same_file_refs(m):  # noqa: ANN001, ANN201
    return m.refs.drop("target_col")


@query("select file_id, caller, line, src from caller_node")
def innermost_owner(m):  # noqa: ANN001, ANN201
    return C.owners(m, m.calls.select("file_id", "caller", "line").distinct(), "caller", "line")


@query("select src, dst, sites from edges")
def call_graph(m):  # noqa: ANN001, ANN201
    return C.call_edges(m)


@query("select * from degrees")
def graph_degrees(m):  # noqa: ANN001, ANN201
    return C.degrees(C.nodes(m), C.call_edges(m))


@query("select f.node_id, f.name, path, callers, call_sites from degrees d join nodes f on f.node_id = d.node_id join files x on x.file_id = f.file_id where callers > 0 order by callers desc, call_sites desc, path, f.node_id limit 25")
def hot_most_called(m):  # noqa: ANN001, ANN201
    n = C.nodes(m)
    d = C.degrees(n, C.call_edges(m)).join(n, "node_id").join(m.files.select("file_id", "path"), "file_id").where("callers > 0")
    return d.select("node_id", "name", "path", "callers", "call_sites").orderBy(F.desc("callers"), F.desc("call_sites"), "path", "node_id").limit(25)


@query("select f.node_id, f.name, path, callees, call_sites from degrees d join nodes f on f.node_id = d.node_id join files x on x.file_id = f.file_id where callees > 0 order by callees desc, f.node_id limit 25")
def hot_widest(m):  # noqa: ANN001, ANN201
    n = C.nodes(m)
    d = C.degrees(n, C.call_edges(m)).join(n, "node_id").join(m.files.select("file_id", "path"), "file_id").where("callees > 0")
    return d.select("node_id", "name", "path", "callees", "call_sites").orderBy(F.desc("callees"), "node_id").limit(25)


@query("select node_id, name, path, cx, loops, loop_depth from metrics where not is_test order by cx desc, node_id limit 25")
def hot_most_complex(m):  # noqa: ANN001, ANN201
    return M.metrics(m).where("not is_test").select("node_id", "name", "path", "cx", "loops", "loop_depth").orderBy(F.desc("cx"), "node_id").limit(25)


@query("""select language, count(*)::bigint as files, coalesce(sum(n), 0)::bigint as funcs, sum(lines)::bigint as lines, round(case when coalesce(sum(n), 0) = 0 then 0 else sum(s)::double / sum(n)::double end, 6) as avg_complexity
from files x left join (select file_id, count(*) as n, sum(cx) as s from metrics group by 1) f on f.file_id = x.file_id group by 1""")
def language_totals(m):  # noqa: ANN001, ANN201
    return M.language_totals(m)


_BAND = "case " + " ".join(f"when cx <= {top} then {band}" for top, band in S.BANDS) + " else 10 end::int"


@query(f"select node_id, name, path, cx, {_BAND} as band, case params when 0 then 'niladic' when 1 then 'monadic' when 2 then 'dyadic' else 'variadic' end as arity, is_test from metrics order by cx desc, node_id limit {M.MOST_COMPLEX}")
def complexity_table(m):  # noqa: ANN001, ANN201
    return M.complexity_table(m)


_BALANCE = """select node_id, key as release_name, count(*) filter (acquire and not guarded) as acquires, count(*) filter (not acquire) as releases, count(*) filter (acquire and guarded) as guarded, min(line) filter (acquire and not guarded) as line,
  coalesce(string_agg(distinct pair, '/' order by pair) filter (acquire and not guarded), '') as names
from (select r.*, case when acquire then release_name else r.name end as key from resources r join funcs f on f.node_id = r.node_id join files x on x.file_id = f.file_id left join pairs p on p.language = x.language and p.acquire_name = r.pair and r.acquire) where key is not null group by 1, 2"""


@query(_BALANCE)
def resource_balance(m):  # noqa: ANN001, ANN201
    return M.resource_balance(m)


_FOUND = """select rule, case when rule in ('deep-loop-nest', 'leak-risk', 'high-complexity') then 'warn' else 'info' end as severity, node_id, path, line, value::bigint as value from (
  select 'inline-candidate' as rule, node_id, path, line, callers as value from fn where body_lines <= 5 and loops = 0 and branches <= 1 and not recursive and callers >= 3
  union all select 'deep-loop-nest', node_id, path, (select min(line) from loops l where l.node_id = fn.node_id and depth >= 3), loop_depth from fn where loop_depth >= 3
  union all select 'high-complexity', node_id, path, line, cx from fn where cx >= 15
  union all select 'long-function', node_id, path, line, body_lines from fn where body_lines >= 120
  union all select 'many-params', node_id, path, line, params from fn where params >= 6
  union all select 'no-callers', node_id, path, line, 0 from fn where callers = 0 and name <> 'main' and name not in (select name from calls)
  union all select 'unroll-candidate', l.node_id, path, l.line, trip from loops l join fn on fn.node_id = l.node_id where trip between 1 and 8
  union all select 'leak-risk', b.node_id, path, b.line, acquires - releases from balance b join fn on fn.node_id = b.node_id where acquires > releases)"""
_FN = "select m.*, callers from metrics m join degrees d on d.node_id = m.node_id where not is_test"


@query("select * from found", found=_FOUND, fn=_FN, balance=_BALANCE)
def lint_findings(m):  # noqa: ANN001, ANN201
    return M.all_lints(m, C.degrees(C.nodes(m), C.call_edges(m)))


@query(f"select * from found order by severity desc, rule, path, line, node_id, value limit {M.MOST_LINTS}", found=_FOUND, fn=_FN, balance=_BALANCE)
def lint_report(m):  # noqa: ANN001, ANN201
    return M.lints(m, C.degrees(C.nodes(m), C.call_edges(m)))


@query("select file_id, path, service from members")
def service_members(m):  # noqa: ANN001, ANN201
    return V.members(m, SERVICES)


@query("select service, count(*) as files, coalesce(sum(n), 0)::bigint as funcs from files x left join members s on s.file_id = x.file_id left join (select file_id, count(*) as n from funcs group by 1) f on f.file_id = x.file_id group by 1")
def service_rollup(m):  # noqa: ANN001, ANN201
    return V.service_rollup(m, V.members(m, SERVICES))


@query("""select coalesce(s, d.src) as src, coalesce(t, d.dst) as dst, coalesce(n, 0)::bigint as edges, coalesce(k, 0)::bigint as sites, s is not null as detected, d.src is not null as declared
from (select a.service as s, b.service as t, count(*) as n, sum(sites) as k from edges e join nodes x on x.node_id = e.src join nodes y on y.node_id = e.dst join members a on a.file_id = x.file_id join members b on b.file_id = y.file_id where a.service <> b.service group by 1, 2) f
full join deps d on d.src = s and d.dst = t""")
def service_edges(m):  # noqa: ANN001, ANN201
    return V.service_edges(C.nodes(m), C.call_edges(m), V.members(m, SERVICES), DEPS)


_ENDS = "select boundary, lower(trim(key)) as key, service, count(*) as n, min(transport) as transport from annotations a join members s on s.file_id = a.file_id group by 1, 2, 3"


@query("select c.key, c.service as src, s.service as dst, case when s.service is null then c.transport when c.transport <> 'unspecified' then c.transport else s.transport end as transport, c.n as calls, coalesce(s.n, 0)::bigint as handlers from ends c left join ends s on s.boundary = 'serves' and s.key = c.key and s.service <> c.service where c.boundary = 'calls'", ends=_ENDS)
def boundary_crossings(m):  # noqa: ANN001, ANN201
    return V.crossings(m, V.members(m, SERVICES))


_CHANGED = "select distinct f.node_id, f.name, x.path from funcs f join files x on x.file_id = f.file_id join hunks h on h.path = x.path and h.start <= f.end_line and f.start_line <= h.stop"


@query(_CHANGED)
def changed_functions(m):  # noqa: ANN001, ANN201
    return spans.changed_functions(m, m.tables["hunks"])


@query("""select n.file_id, n.line, n.key, node_id from (select distinct file_id, line, key from annotations) n left join (select file_id, line, key, node_id from (select a.file_id, a.line, a.key, f.node_id,
  row_number() over (partition by a.file_id, a.line, a.key order by case when a.line between start_line and end_line then 0 else 1 end, case when a.line between start_line and end_line then -start_line else start_line end, -f.node_id) as rn
  from (select distinct file_id, line, key from annotations) a join funcs f on f.file_id = a.file_id and (a.line between start_line and end_line or start_line - a.line between 1 and 10)) where rn = 1) b on b.file_id = n.file_id and b.line = n.line and b.key = n.key""")
def bind_annotations(m):  # noqa: ANN001, ANN201
    return spans.bind_annotations(m)


@query("select node_id, min(distance)::int as distance from reach group by 1", changed=_CHANGED, reach="select node_id, 0 as distance from changed union select e.src, r.distance + 1 from reach r join edges e on e.dst = r.node_id where r.distance < 8")
def callers_of_changes(m):  # noqa: ANN001, ANN201
    return spans.callers_within(C.call_edges(m), spans.changed_functions(m, m.tables["hunks"]))


_HITS = "select 'func' as kind, file_id, line, name from funcs where contains(lower(name), 'f1') union all select 'const', file_id, line, name from consts where contains(lower(name), 'f1') union all select 'type', file_id, line, name from types where contains(lower(name), 'f1') union all select 'note', file_id, line, text from notes where contains(lower(text), 'f1')"


@query(f"select *, (select count(*) from hits) as total from hits order by kind, file_id, line, name limit {search.MOST_HITS}", hits=_HITS)
def find_symbol(m):  # noqa: ANN001, ANN201
    return search.find(m, "F1")


@query("select file_id, line, text from notes where regexp_matches(text, '(?i)(?:^|\\s)(?:BUG|FIXME|HACK|NOTE|SAFETY|TODO|XXX)(?:\\([^)]*\\))?:') and contains(upper(text), 'TODO')")
def notes_todo(m):  # noqa: ANN001, ANN201
    return search.notes_by_marker(m, "todo")


PROBES = ("f12", "F77x", "tst_f3", "nothing_like_it")


@query(f"""select probe, name, score from (select probe, name, score, row_number() over (partition by probe order by score, name) as rn from (select probe, name, (case when q = n then 0 when contains(n, q) or contains(q, n) then 1000 + abs(length(q) - length(n)) when levenshtein(q, n) <= greatest(2, length(q) // 3) then 2000 + levenshtein(q, n) end)::bigint as score
  from (select distinct name, lower(name) as n from funcs) cross join (select unnest({list(PROBES)}) as probe, lower(unnest({list(PROBES)})) as q)) where score is not null) where rn <= {search.NEAREST}""")
def nearest_names(m):  # noqa: ANN001, ANN201
    return search.nearest_names(m.funcs, m.spark.createDataFrame([(p,) for p in PROBES], "probe string"))


@query("select * from tests_of")
def covering_tests(m):  # noqa: ANN001, ANN201
    return T.covering_tests(m)


@query("""select (select count(*) from (select distinct file_id, caller from tcalls where caller <> '<top>')) as tests, count(*) filter (rung = -1) as external_calls, count(*) filter (rung is null) as unresolved_calls,
  (select count(distinct node_id) from thits where caller <> '<top>') as covered, (select count(distinct node_id) from thits where node_id not in (select node_id from thits where caller <> '<top>')) as touched from trung""")
def coverage_totals(m):  # noqa: ANN001, ANN201
    return T.coverage_totals(m)


def _members(m):  # noqa: ANN001, ANN202
    if "members" not in m.derived:
        m.fix("files", "funcs", "imports")
        m.derived["members"] = C.cut(V.members(m, SERVICES))
    return m.derived["members"]


def _resolved(m):  # noqa: ANN001, ANN202
    if "resolved" not in m.derived:
        m.derived["resolved"] = C.cut(R.resolved_calls(m, _members(m)))
    return m.derived["resolved"]


def _symbols(m):  # noqa: ANN001, ANN202
    if "symbols" not in m.derived:
        m.derived["symbols"] = C.cut(R.edge_symbols(m, _members(m), _resolved(m)))
    return m.derived["symbols"]


@query("select service, file_id, name, qualifier, recv_type, target, via, reason, array_to_string(candidates, ',') as candidates from resolved")
def service_resolution(m):  # noqa: ANN001, ANN201
    return _resolved(m).drop("line").withColumn("candidates", F.array_join("candidates", ","))


@query("select src, dst, symbol, path, line, via, kind from symbols")
def service_edge_symbols(m):  # noqa: ANN001, ANN201
    return _symbols(m)


@query("select * from evident_edges")
def service_edges_by_evidence(m):  # noqa: ANN001, ANN201
    return R.overlay(_symbols(m), DEPS)


@query("select src, symbol, path, line, reason, candidates from (select service as src, name as symbol, path, line, reason, array_to_string(candidates, ',') as candidates, row_number() over (partition by service, name order by path, line, reason, array_to_string(candidates, ',')) as rn from rcalls where reason in ('ambiguous', 'no-evidence')) where rn = 1 order by path, line, src, symbol limit 100")
def unresolved_calls(m):  # noqa: ANN001, ANN201
    return R.unresolved(m, _resolved(m))


@query("select * from sites")
def crossing_sites(m):  # noqa: ANN001, ANN201
    return R.crossing_sites(m, V.members(m, SERVICES))


@query("""select coalesce(e.src, n.src) as src, coalesce(e.dst, n.dst) as dst, coalesce(declared, false) as declared, coalesce(detected, false) or n.src is not null as detected, (coalesce(symbols, 0) + coalesce(more, 0))::bigint as symbols
from evident_edges e full join (select src, dst, count(*) as more from (select distinct src, dst, key, path, line from sites where src <> '' and dst <> '') x where not exists (select 1 from symbols s where s.src = x.src and s.dst = x.dst and s.symbol = x.key and s.path = x.path and s.line = x.line) group by 1, 2) n on n.src = e.src and n.dst = e.dst""")
def merged_edges(m):  # noqa: ANN001, ANN201
    edges = R.overlay(_symbols(m), DEPS)
    return R.merge_crossings(edges, _symbols(m), R.crossing_counts(m, _members(m)))[0]


_CHANGED_SV = "select distinct service from members where path in (select path from hunks)"


@query("""select service, case when len(way) = 1 then 'changed' else 'dependency' end as reason, array_to_string(way, ' <- ') as path from (select *, row_number() over (partition by service order by len(way), way) as rn from walk) where rn = 1""", starts=_CHANGED_SV, walk="select service, [service] as way from starts union select e.src, list_append(w.way, e.src) from walk w join evident_edges e on e.dst = w.way[-1] where not list_contains(w.way, e.src)")
def impact_of_changes(m):  # noqa: ANN001, ANN201
    changed = _members(m).join(m.tables["hunks"].select("path").distinct(), "path", "left_semi").select("service").distinct()
    return R.impact(R.overlay(_symbols(m), DEPS), changed)



def _graph(m):  # noqa: ANN001, ANN202
    edges = C.call_edges(m)
    return C.nodes(m), edges, P._cycles(m, edges)


@query("select node_id, cycle from scc")
def call_cycles(m):  # noqa: ANN001, ANN201
    return _graph(m)[2]


@query("select cycle, count(*) as size, string_agg(node_id::varchar, ',' order by node_id) filter (i <= 12) as members from (select *, row_number() over (partition by cycle order by node_id) as i from scc) group by cycle order by size desc, cycle limit 25")
def largest_cycles(m):  # noqa: ANN001, ANN201
    return G.cycles(_graph(m)[2])


@query("select node_id, depth::int as depth from comp join depths on depths.c = comp.c")
def call_depth(m):  # noqa: ANN001, ANN201
    return G.depth_below(*_graph(m))


@query("select node_id as root, depth::int as depth, chain from (select r.node_id, d.depth, (select string_agg(x::varchar, ',' order by i) from (select unnest(w.path) as x, unnest(range(len(w.path))) as i)) as chain from roots r join depths d on d.c = r.c join walkdown w on w.root = r.node_id and len(w.path) = d.depth + 1)", roots="select c.node_id, c.c from comp c join depths d on d.c = c.c where depth > 0 and c.node_id not in (select dst from links) order by depth desc, c.node_id limit 25",
    down="select a, b from (select g.a, g.b, row_number() over (partition by g.a order by depth desc, g.b) as rn from dag g join depths d on d.c = g.b) where rn = 1", walkdown="select node_id as root, c as last, [node_id] as path from roots union all select w.root, d.b, list_append(w.path, d.b) from walkdown w join down d on d.a = w.last")
def deepest_chains(m):  # noqa: ANN001, ANN201
    return G.deepest_chains(*_graph(m))


@query()
def flame_tree(m):  # noqa: ANN001, ANN201
    nodes, edges, _ = _graph(m)
    called = edges.where("src <> dst").select(F.col("dst").alias("node_id")).distinct()
    return G.flame(edges, nodes.select("node_id").join(called, "node_id", "left_anti"))


@query("select file_id, path, split_part(path, '/', 1) as service from files")
def fallback_services(m):  # noqa: ANN001, ANN201
    return G.fallback_members(m)


_TARGET_PARTS = {
    "hots": "select greatest(list_extract(l, len(l) * 9 // 10 + 1), 3) as hot from (select list_sort(list(call_sites)) as l from degrees where call_sites > 0)",
    "of_node": "select n.node_id, (select min(service) from members m where m.file_id = n.file_id) as service from nodes n",
    "crossed": "select e.dst as node_id, count(distinct a.service) as services, count(*) as crossed from edges e join of_node a on a.node_id = e.src join of_node b on b.node_id = e.dst where a.service is not null and b.service is distinct from a.service group by 1",
    "tf": """select m.*, callers, callees, call_sites, depth, o.service, coalesce(services, 0) as services, coalesce(crossed, 0) as crossed, (select count(*) from resources r where r.node_id = m.node_id) as res, (select count(*) from resources r where r.node_id = m.node_id and acquire) as acq, m.node_id in (select node_id from thits) as covered, m.node_id in (select node_id from changed) as pinned, hot
  from metrics m join degrees d on d.node_id = m.node_id join comp c on c.node_id = m.node_id join depths on depths.c = c.c join of_node o on o.node_id = m.node_id left join crossed x on x.node_id = m.node_id, hots where not is_test""",
    "tg": "select *, coalesce(call_sites >= hot and (loop_depth > 0 or res > 0), false) as is_hot from tf where pinned or covered or cx > 1 or callees > 0 or callers > 0 or body_lines > 3",
    "scored": """select node_id, kind, score, row_number() over (partition by node_id order by score desc, i) as rn, max(score) over (partition by node_id) as top from (select node_id, unnest(['perf-test', 'integration-test', 'contract-test', 'load-test', 'smoke-test']) as kind, unnest([1, 2, 3, 4, 5]) as i,
  unnest([loop_depth * loop_depth * 10 + case when recursive then depth * 2 else 0 end, callees * 4 + depth * 3 + cx, services * 25, case when is_hot then call_sites * 4 + loop_depth * 10 else 0 end, 8 + case when callers = 0 then 20 else 0 end]::bigint[]) as score from tg) where score > 0""",
    "targets": """select g.node_id, path || '::' || name as id, service, (select kind from scored s where s.node_id = g.node_id and rn = 1) as kind, coalesce((select string_agg(kind, ',' order by rn) from scored s where s.node_id = g.node_id and rn > 1 and score * 5 >= top * 2), '') as also,
  (cx * 3 + loop_depth * 8 + depth * 4 + call_sites * 2 + callees * 3 + crossed * 10 + case when covered then 0 else 40 end + case when recursive then 6 else 0 end)::bigint as priority, covered, pinned,
  concat_ws('; ', case when loop_depth >= 2 then loop_depth || ' nested loop levels' end, case when recursive then 'recursive, over a chain ' || depth || ' deep' end, case when services > 0 then 'called from ' || services || ' other service(s)' end, case when callees >= 3 or depth >= 3 then callees || ' direct call-out(s), chain ' || depth || ' deep' end,
    case when is_hot then call_sites || ' call sites from ' || callers || ' caller(s)' end, case when callers = 0 then 'nothing calls it' end, case when cx >= 10 then cx || ' decision points' end) as why,
  concat_ws('; ', case when regexp_matches(coalesce(ret, ''), 'Result|[Ee]rror') then 'fallible' end, case when regexp_matches(coalesce(ret, ''), 'Option|null|undefined') then 'may return nothing' end, case when res > 0 then 'acquires ' || acq end, case when not is_typed then 'untyped' end, case when owner is not null then 'method' end) as semantics from tg g""",
    "kept_targets": "select * from targets where pinned union all (select * from targets where not pinned order by priority desc, node_id limit 60)",
    "changed": _CHANGED,
    "reach": "select node_id, 0 as distance from changed union select e.src, r.distance + 1 from reach r join edges e on e.dst = r.node_id where r.distance < 8",
    "near": "select node_id, min(distance)::int as distance from reach group by 1",
    "thit": "select t.test, t.file, f.name, min(t.node_id) as first, min(distance) as d, min(t.line) as line, min(t.language) as language from tests_of t join near r on r.node_id = t.node_id join metrics f on f.node_id = t.node_id where not is_test and t.rank <= 25 group by 1, 2, 3",
    "torun": "select test, file, min(line) as line, min(language) as language, min(d) as distance, string_agg(name, ',' order by name) filter (i <= 8) as covers from (select *, row_number() over (partition by test, file order by first, name) as i from thit) group by 1, 2",
    "rep": """select c.node_id, f.name as function, c.path, f.start_line, f.end_line, coalesce((select string_agg(service, ',' order by service) from members m where m.file_id = f.file_id), '') as services, f.is_test or f.node_id in (select node_id from thits) as tested,
  coalesce((select string_agg(test, ',' order by rank) from tests_of t where t.node_id = c.node_id and rank <= 25), '') as tested_by,
  coalesce((select string_agg(distinct service, ',' order by service) from resolved r where r.target is not null and r.name = f.name and r.service not in (select service from members m where m.file_id = f.file_id)), '') as called_from from changed c join metrics f on f.node_id = c.node_id""",
}


def _targets(m):  # noqa: ANN001, ANN202
    return P.test_targets(m, V.members(m, SERVICES), spans.changed_functions(m, m.tables["hunks"]))


def _report(m):  # noqa: ANN001, ANN202
    return P.changed_report(m, m.tables["hunks"], V.members(m, SERVICES), _resolved(m))


@query("select * from kept_targets", **_TARGET_PARTS)
def test_targets(m):  # noqa: ANN001, ANN201
    return _targets(m)


@query("select kind, count(*) as functions, count(*) filter (not covered) as untested from kept_targets group by 1", **_TARGET_PARTS)
def target_summary(m):  # noqa: ANN001, ANN201
    return P.target_summary(_targets(m))


@query("select * from torun", **_TARGET_PARTS)
def triggered_tests(m):  # noqa: ANN001, ANN201
    return P.triggered_tests(m, m.tables["hunks"])


@query("""select language, case language when 'rust' then 'cargo test -- ' || string_agg(test, ' ' order by distance, file, test) when 'go' then 'go test -run ' || chr(39) || '^(' || string_agg(test, '|' order by distance, file, test) || ')$' || chr(39) || ' ' || (select string_agg(d, ' ' order by d) from (select distinct './' || regexp_extract(file, '^(.*)/[^/]*$', 1) as d from torun t where t.language = 'go'))
  when 'python' then 'pytest -k "' || string_agg(test, ' or ' order by distance, file, test) || '"' when 'typescript' then 'npx jest -t "' || string_agg(test, '|' order by distance, file, test) || '"' when 'cpp' then 'ctest -R ' || chr(39) || string_agg(test, '|' order by distance, file, test) || chr(39) end as command, count(*) as selects from torun where language <> 'csharp' group by language""", **_TARGET_PARTS)
def test_commands(m):  # noqa: ANN001, ANN201
    return P.test_commands(P.triggered_tests(m, m.tables["hunks"]))


@query("select *, total_tests > 0 and tests_to_run * 5 >= total_tests * 4 as full_suite_advised from (select count(*) as tests_to_run, count(*) filter (distance = 0) as direct, (select count(*) from (select distinct file_id, caller from tcalls where caller <> '<top>')) as total_tests from torun)", **_TARGET_PARTS)
def trigger_totals(m):  # noqa: ANN001, ANN201
    return P.trigger_totals(P.triggered_tests(m, m.tables["hunks"]), T.coverage_totals(m))


# all tests of a function; the other queries only ask whether there are any
@query("select * from rep", **_TARGET_PARTS | {"rep": _TARGET_PARTS["rep"].replace(" and rank <= 25", "")})
def changed_report(m):  # noqa: ANN001, ANN201
    return _report(m)


@query("select path || '::' || function as id, start_line, end_line, path || '::' || function in (select id from kept_targets) as resolved from rep where tested_by = '' and node_id in (select node_id from metrics where not is_test) and function not in (select unnest(string_split(covers, ',')) from torun)", **_TARGET_PARTS)
def coverage_gaps(m):  # noqa: ANN001, ANN201
    return P.coverage_gaps(m, _report(m), P.triggered_tests(m, m.tables["hunks"]), _targets(m))


@query("select kind, file_id, path, line, detail, narrowed from (select *, max(narrowed) over () as found from (select 'func' as kind, f.file_id, path, line, ret as detail, coalesce(owner = 'T5', false) or regexp_extract(path, '([^/]*)[.][^.]*$', 1) = 'T5' as narrowed from funcs f join files x on x.file_id = f.file_id where f.name = 'f5'\n  union all select 'const', c.file_id, path, line, ty, coalesce(ty = 'T5', false) from consts c join files x on x.file_id = c.file_id where c.name = 'f5' union all select 'type', t.file_id, path, line, kind, false from types t join files x on x.file_id = t.file_id where t.name = 'f5')) where narrowed or not found")
def symbol_definitions(m):  # noqa: ANN001, ANN201
    return L.definitions(m, "T5::f5")


@query(f"select *, (select count(*) from hits) as total from hits order by path, line, kind, caller nulls first, qualifier nulls first limit {L.MOST_REFERENCES}", hits="select 'call' as kind, path, line, caller, qualifier from calls c join files x on x.file_id = c.file_id where name = 'f7' union all select case when reexport then 'reexport' else 'import' end, path, line, null, module from imports i join files x on x.file_id = i.file_id where list_contains(string_split(names_csv, ','), 'f7') or (names_csv = '' and regexp_extract(module, '([A-Za-z0-9_]*)$', 1) = 'f7')")
def symbol_references(m):  # noqa: ANN001, ANN201
    return L.references(m, "f7")


_DEP_PARTS = {
    "bysegs": "select distinct i.file_id, i.names, a.stem as word, a.target as dst from (select *, unnest(segs) as seg from imps) i join answers a on a.stem = i.seg and a.target <> i.file_id",
    "bynames": "select distinct i.file_id, a.stem as symbol, a.target as dst from (select file_id, unnest(names) as nm from imps) i join answers a on a.stem = i.nm and a.target <> i.file_id",
    "binds": "select file_id, dst, unnest(names) as symbol from bysegs union select file_id, dst, symbol from bynames",
    "avail": "select * from binds union select b.file_id, b.dst, f.name from bysegs b join funcs f on f.file_id = b.dst where len(b.names) = 0",
    "dcalls": "select distinct file_id, name, qualifier from calls c where name in (select name from funcs) and not exists (select 1 from funcs f where f.file_id = c.file_id and f.name = c.name)",
    "dsegs": "select d.*, unnest(list_filter(string_split_regex(coalesce(qualifier, ''), '[^A-Za-z0-9_-]+'), lambda x: x <> '')) as seg from dcalls d",
    "stems": "select file_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') as stem from files",
    "dhits": """select distinct h.file_id, h.name, h.qualifier, h.dst from (select d.file_id, d.name, d.qualifier, s.file_id as dst from dsegs d join stems s on s.stem = d.seg union select d.file_id, d.name, d.qualifier, v.dst from dcalls d join avail v on v.file_id = d.file_id and v.symbol = d.name
  union select d.file_id, d.name, d.qualifier, v.dst from dsegs d join avail v on v.file_id = d.file_id and v.symbol = d.seg union select d.file_id, d.name, d.qualifier, v.dst from dsegs d join answers a on a.stem = d.seg join avail v on v.file_id = a.target and v.symbol = d.name and v.dst <> a.target) h join funcs f on f.file_id = h.dst and f.name = h.name""",
    "dep_symbols": "select file_id as src, dst, symbol from binds union select file_id, dst, word from bysegs where len(names) = 0 union select file_id, min(dst), name from dhits group by file_id, name, qualifier having count(*) = 1",
}


@query("select src, dst, count(*) as n_symbols, string_agg(symbol, ',' order by symbol) filter (i <= 20) as symbols from (select *, row_number() over (partition by src, dst order by symbol) as i from dep_symbols) group by 1, 2", **_DEP_PARTS)
def file_dependencies(m):  # noqa: ANN001, ANN201
    return L.dependencies(m)


@query("select distinct name, case when n is null then 'excluded' else 'ambiguous' end as reason from (select d.name, h.n from dcalls d left join (select file_id, name, qualifier, count(*) as n from dhits group by 1, 2, 3) h on h.file_id = d.file_id and h.name = d.name and h.qualifier is not distinct from d.qualifier) where n is null or n > 1", **_DEP_PARTS)
def unlinked_names(m):  # noqa: ANN001, ANN201
    return L.unlinked(m)


_COUNTS = "select path, language, " + ", ".join(f"(select count(*) from {t} y where y.file_id = x.file_id) as {k}" for k, t in (("funcs", "funcs"), ("consts", "consts"), ("refs", "refs"), ("notes", "notes"), ("mods", "modules")))
_COUNTS += ", coalesce((select sum(greatest(len(list_filter(string_split(names_csv, ','), lambda z: z <> '')), 1)) from imports y where y.file_id = x.file_id and reexport), 0)::bigint as exports from files x"


@query(_COUNTS)
def file_index(m):  # noqa: ANN001, ANN201
    return L.file_counts(m)


@query("select count(*) as files, " + ", ".join(f"sum({k})::bigint as {k}" for k in ("funcs", "consts", "refs", "notes", "mods", "exports")) + " from counted where path like 'svc1/%'", counted=_COUNTS)
def index_totals(m):  # noqa: ANN001, ANN201
    return L.totals(L.file_counts(m, "svc1/"))


@query("select node_id, name, path, cx from metrics order by cx desc, node_id limit 40 offset 80")
def metrics_page(m):  # noqa: ANN001, ANN201
    return L.page(M.metrics(m).select("node_id", "name", "path", "cx"), F.desc("cx"), "node_id", offset=80, limit=40, default=40)


@query("select x.file_id, path, 'ambiguous' as how from files x where path like '%.py'")
def file_lookup(m):  # noqa: ANN001, ANN201
    return L.find_file(m, ".py")


@query("select name, kind, path from (select *, row_number() over (order by score, r, name) as rn from (select *, row_number() over (partition by lower(name) order by score, r, name, path) as one from (select *, case when lower(name) = 'k_12' then 0 when contains(lower(name), 'k_12') or contains('k_12', lower(name)) then 1000 + least(abs(length(name) - 4), 999) when levenshtein(lower(name), 'k_12') <= 2 then 2000 + levenshtein(lower(name), 'k_12') end as score from (select 0 as r, 'type' as kind, name, path from types t join files x on x.file_id = t.file_id union all select 1, 'func', name, path from funcs f join files x on x.file_id = f.file_id union all select 2, 'const', name, path from consts c join files x on x.file_id = c.file_id union all select 3, 'import', nm, path from (select file_id, unnest(list_filter(string_split(names_csv, ','), lambda z: z <> '')) as nm from imports) i join files x on x.file_id = i.file_id)) where score is not null) where one = 1) where rn <= 8")
def suggestions(m):  # noqa: ANN001, ANN201
    return L.suggest(m, "K_12")


@query("select * from (values " + ", ".join(f"('{r}', '{v}')" for r, v in sorted(M.RULES.items())) + ") v(rule, severity)")
def rule_catalogue(m):  # noqa: ANN001, ANN201
    return M.rule_catalogue(m.spark)


@query("select file_id, path, case regexp_extract(path, '[.]([^.]*)$', 1) when 'rs' then 'rust' when 'py' then 'python' when 'ts' then 'typescript' when 'go' then 'go' when 'cpp' then 'cpp' when 'cs' then 'csharp' end as language from files")
def files_by_extension(m):  # noqa: ANN001, ANN201
    ext = extensions(m.spark).withColumnRenamed("language", "named")
    return m.files.withColumn("ext", F.lower(S.extension("path"))).join(F.broadcast(ext), "ext").select("file_id", "path", F.col("named").alias("language"))


@query("select node_id, name from nodes where node_id not in (select dst from edges where src <> dst)")
def root_nodes(m):  # noqa: ANN001, ANN201
    return L.roots(C.nodes(m), C.call_edges(m)).select("node_id", "name")


@query(f"select band, count(*) as functions, count(*) filter (is_test) as tests, max(cx) as greatest from (select cx, is_test, {_BAND} as band from metrics order by cx desc, node_id limit {M.MOST_COMPLEX}) group by 1")
def complexity_by_band(m):  # noqa: ANN001, ANN201
    return L.by_band(M.complexity_table(m))


@query(f"select * from (select node_id, name, path, cx, {_BAND} as band, case params when 0 then 'niladic' when 1 then 'monadic' when 2 then 'dyadic' else 'variadic' end as arity, is_test from metrics order by cx desc, node_id limit {M.MOST_COMPLEX}) where band between 3 and 6 and arity in ('monadic', 'dyadic') and not is_test and (contains(lower(name), 'svc1') or contains(lower(path), 'svc1'))")
def complexity_filtered(m):  # noqa: ANN001, ANN201
    return L.complexity_filter(M.complexity_table(m), "SVC1", ("monadic", "dyadic"), 3, 6, tests=False)


@query("select src, dst, symbol, caller, path from (select *, row_number() over (partition by src, dst order by symbol) as i from (select a.service as src, b.service as dst, y.name as symbol, x.name as caller, a.path, row_number() over (partition by a.service, b.service, y.name order by a.path, x.name) as one from edges e join nodes x on x.node_id = e.src join nodes y on y.node_id = e.dst join members a on a.file_id = x.file_id join members b on b.file_id = y.file_id where a.service <> b.service) where one = 1) where i <= 60")
def service_edge_sites(m):  # noqa: ANN001, ANN201
    return L.edge_sites(m, C.nodes(m), C.call_edges(m), V.members(m, SERVICES))


@query("select path, line, name, (select count(*) from hits) as sites from hits order by path, line, name limit 3", hits="select path, line, name from calls c join files x on x.file_id = c.file_id where qualifier like 'std::%' or qualifier = 'std'")
def qualifier_sites(m):  # noqa: ANN001, ANN201
    return L.qualifier_evidence(m, "STD")


@query("select file_id, path from files where file_id not in (select file_id from members)")
def unassigned_files(m):  # noqa: ANN001, ANN201
    return m.files.select("file_id", "path").join(V.members(m, SERVICES).select("file_id").distinct(), "file_id", "left_anti")


_RANKED = {
    "v1": "select f.node_id, row_number() over (order by callers desc, call_sites desc, path, f.node_id) as rank from degrees d join nodes f on f.node_id = d.node_id join files x on x.file_id = f.file_id where callers > 0",
    "v2": "select d.node_id, row_number() over (order by callees desc, d.node_id) as rank from degrees d join nodes f on f.node_id = d.node_id join files x on x.file_id = f.file_id where callees > 0",
    "v3": "select node_id, row_number() over (order by cx desc, node_id) as rank from metrics where not is_test",
}


@query("select n.node_id, n.name, v1.rank::int as called, v2.rank::int as wide, v3.rank::int as complex, concat_ws('+', case when v1.rank is not null then 'called' end, case when v2.rank is not null then 'wide' end, case when v3.rank is not null then 'complex' end) as badge from nodes n left join (select * from v1 where rank <= 25) v1 on v1.node_id = n.node_id left join (select * from v2 where rank <= 25) v2 on v2.node_id = n.node_id left join (select * from v3 where rank <= 25) v3 on v3.node_id = n.node_id where v1.rank is not null or v2.rank is not null or v3.rank is not null", **_RANKED)
def hot_functions(m):  # noqa: ANN001, ANN201
    ranked = lambda df, *o: df.withColumn("rank", F.row_number().over(Window.orderBy(*o)))
    n = C.nodes(m)
    d = C.degrees(n, C.call_edges(m)).join(n, "node_id").join(m.files.select("file_id", "path"), "file_id")
    # 25 rows each are ranked
    called = d.where("callers > 0").orderBy(F.desc("callers"), F.desc("call_sites"), "path", "node_id").limit(25)
    wide = d.where("callees > 0").orderBy(F.desc("callees"), "node_id").limit(25)
    complex_ = M.metrics(m).where("not is_test").orderBy(F.desc("cx"), "node_id").limit(25)
    return L.fold_hot(n, called=ranked(called, F.desc("callers"), F.desc("call_sites"), "path", "node_id"), wide=ranked(wide, F.desc("callees"), "node_id"), complex=ranked(complex_, F.desc("cx"), "node_id"))


@query("""select (select count(distinct path) from hunks) as changed_files, (select count(distinct path) from hunks where path not in (select path from members)) as unassigned_files, (select count(*) from rep) as changed_functions, (select count(*) from rep where not tested) as untested,
  (select count(distinct service) from walk) as services_to_test, (select count(*) from (select 1 from (select distinct service, name from rcalls where reason in ('ambiguous', 'no-evidence')) limit 100)) as unresolved_calls, (select count(*) from sites) as crossings, (select count(*) from sites where remote_path is null) as unmatched_crossings, (select count(*) from trung where rung = -1) as external_test_calls""",
    starts=_CHANGED_SV, walk="select service, [service] as way from starts union select e.src, list_append(w.way, e.src) from walk w join evident_edges e on e.dst = w.way[-1] where not list_contains(w.way, e.src)", **_TARGET_PARTS)
def change_counts(m):  # noqa: ANN001, ANN201
    member = _members(m)
    r = _resolved(m)
    changed = member.join(m.tables["hunks"].select("path").distinct(), "path", "left_semi").select("service").distinct()
    return P.change_counts(m, m.tables["hunks"], member, _report(m), R.impact(R.overlay(_symbols(m), DEPS), changed), R.unresolved(m, r), R.crossing_counts(m, member))
