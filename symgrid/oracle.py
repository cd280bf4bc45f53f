"""DuckDB SQL that the registered queries are held against: named parts, put together as needed."""

from __future__ import annotations

import re

from .codemap import DEPS, SERVICES, TABLE_SQL
from .functions.predicates import glob_regex
from .schema import LANGUAGES

_SEGS = lambda c: f"list_filter(string_split_regex({c}, '[^A-Za-z0-9_-]+'), lambda x: x <> '')"
_DIR = lambda p: f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"
_STEM = lambda p: f"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1')"
_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
TEST_PATH = lambda p: f"(regexp_matches(lower({p}), '(^|/)(test|tests|__tests__|spec|testdata)/') or regexp_matches(regexp_replace(regexp_extract(lower({p}), '([^/]*)$', 1), '[.][^.]*$', ''), '^test_|_test$|[.]test$|[.]spec$|_spec$'))"
TEST_NAME = lambda n: f"(regexp_matches(lower(ltrim({n}, '_')), '^test_|_test$|_spec$') or regexp_matches(ltrim({n}, '_'), '^(Test|Benchmark|Example|Fuzz)[A-Z]|^(bench|context|describe|it|specify|suite|test)[(]'))"

PARTS: dict[str, str] = {
    **TABLE_SQL,
    "frames": "select distinct file_id, -1 - file_id as node_id from calls where caller = '<top>'",
    "nodes": "select node_id, file_id, name, false as is_module from funcs union all select node_id, file_id, '<top>', true from frames",
    "aliases": f"""select distinct file_id, alias from (select file_id, {_STEM("path")} as alias from files union all select file_id, unnest(string_split({_DIR("path")}, '/')) from files union all select file_id, name from modules union all select file_id, name from types) where alias <> ''
  and not (alias in ('src', 'pkg', 'internal', 'cmd', 'app', 'lib', 'test', 'tests', 'include') and alias not in (select 'none'))""",
    "imps": f"select distinct file_id, module, list_filter(string_split(names_csv, ','), lambda x: x <> '') as names, {_SEGS('module')} as segs from imports",
    "answers": f"select distinct stem, file_id as target from (select file_id, {_STEM('path')} as stem from files union all select file_id, regexp_extract({_DIR('path')}, '([^/]*)$', 1) from files where {_STEM('path')} in ('__init__', 'index', 'mod')) where stem <> ''",
    "lasts": "select i.file_id, module, names, target from imps i join answers a on a.stem = segs[-1] and target <> i.file_id",
    "anys": "select distinct i.file_id, module, names, target from (select *, unnest(segs) as seg from imps) i join answers a on a.stem = seg and target <> i.file_id where not exists (select 1 from lasts l where l.file_id = i.file_id and l.module = i.module and l.names = i.names)",
    "itargets": "select distinct * from (select * from lasts union all select * from anys union all select i.file_id, module, names, target from (select file_id, module, names, unnest(names) as nm from imps) i join answers a on a.stem = nm and target <> i.file_id)",
    "bound0": "select distinct * from (select file_id, unnest(names) as name, target from itargets union all select t.file_id, f.name, target from itargets t join funcs f on f.file_id = target where len(names) = 0)",
    "bound1": "select * from bound0 union select a.file_id, a.name, b.target from bound0 a join bound0 b on a.target = b.file_id and a.name = b.name where b.target <> a.file_id",
    "bound2": "select * from bound1 union select a.file_id, a.name, b.target from bound1 a join bound1 b on a.target = b.file_id and a.name = b.name where b.target <> a.file_id",
    "imported": "select * from bound2 union select a.file_id, a.name, b.target from bound2 a join bound2 b on a.target = b.file_id and a.name = b.name where b.target <> a.file_id",
    "named": "select file_id, name, node_id, start_line, end_line from funcs union all select file_id, '<top>', node_id, null, null from frames",
    "call_spots": "select distinct file_id, caller, line from calls",
    "caller_node": """select file_id, caller, line, node_id as src from (select s.*, node_id, row_number() over (partition by s.file_id, s.caller, s.line order by case when start_line <= s.line and s.line <= end_line then 0 else 1 end, case when start_line <= s.line and s.line <= end_line then -start_line else 0 end, case when start_line <= s.line and s.line <= end_line then -node_id else node_id end) as rn
  from call_spots s join named d on d.file_id = s.file_id and d.name = s.caller) where rn = 1""",
    "first_def": "select file_id, name, min(node_id) as dst from funcs group by all",
    "refs": "select distinct c.file_id, c.caller, c.line as call_line, f.line as target_line, c.name as target_name, f.ret as target_ret from calls c join first_def d on d.file_id = c.file_id and d.name = c.name join funcs f on f.node_id = d.dst where c.recv_type is null",
    "local_edges": "select o.src, d.dst from refs r join caller_node o on o.file_id = r.file_id and o.caller = r.caller and o.line = r.call_line join first_def d on d.file_id = r.file_id and d.name = r.target_name",
    "methods": "select owner as ty, name, min(node_id) as dst from funcs where owner is not null group by all having count(*) = 1",
    "typed_edges": "select o.src, m.dst, c.line from calls c join methods m on m.ty = c.recv_type and m.name = c.name join caller_node o on o.file_id = c.file_id and o.caller = c.caller and o.line = c.line where o.src <> m.dst",
    "open_calls": "select c.* from calls c where (recv_type is null and not exists (select 1 from first_def d where d.file_id = c.file_id and d.name = c.name)) or (recv_type is not null and not exists (select 1 from methods m where m.ty = c.recv_type and m.name = c.name))",
    "evident": f"""select file_id, name, qualifier, min(node_id) as dst from (select distinct k.file_id, k.name, k.qualifier, f.node_id from (select distinct file_id, name, qualifier from open_calls) k join funcs f on f.name = k.name and f.file_id <> k.file_id
  where exists (select 1 from aliases a where a.file_id = f.file_id and list_contains({_SEGS("coalesce(k.qualifier, '')")}, a.alias)) or exists (select 1 from imported i where i.file_id = k.file_id and i.name = k.name and i.target = f.file_id)) group by all having count(*) = 1""",
    "cross_edges": "select o.src, e.dst, c.line from open_calls c join evident e on e.file_id = c.file_id and e.name = c.name and e.qualifier is not distinct from c.qualifier join caller_node o on o.file_id = c.file_id and o.caller = c.caller and o.line = c.line",
    # what is met of an edge, in order: a typed call counts only where it is the very first
    "met": "select *, row_number() over (partition by src, dst order by phase, line, typed) as nth from (select src, dst, 0 as phase, 0 as line, false as typed from local_edges union all select src, dst, 1, line, false from cross_edges union all select src, dst, 1, line, true from typed_edges)",
    "edges": "select src, dst, (count(*) filter (not typed or nth = 1))::bigint as sites from met group by src, dst",
    "degrees": "select n.node_id, coalesce(callers, 0)::bigint as callers, coalesce(callees, 0)::bigint as callees, coalesce(sites, 0)::bigint as call_sites from nodes n left join (select dst, count(*) as callers, sum(sites) as sites from edges group by 1) i on i.dst = n.node_id left join (select src, count(*) as callees from edges group by 1) o on o.src = n.node_id",
    "nloops": "select node_id, count(*) as loops, max(depth) as loop_depth from loops group by 1",
    "metrics": f"""select f.*, x.path, x.language, x.is_typed, x.family, coalesce(loops, 0)::bigint as loops, coalesce(loop_depth, 0)::bigint as loop_depth, (1 + f.branches + coalesce(loops, 0))::bigint as cx, (f.test_ctx or {TEST_PATH("x.path")}) as is_test
  from funcs f join files x on x.file_id = f.file_id left join nloops l on l.node_id = f.node_id""",
    "globs": f"select * from (values {_VALUES([(s, r) for s, gs in SERVICES.items() for g in gs for r in glob_regex(g)])}) v(service, regex)",
    "deps": f"select * from (values {_VALUES([(a, b) for a, bs in DEPS.items() for b in bs])}) v(src, dst)",
    "members": "select distinct file_id, path, service from files join globs on regexp_matches(path, regex)",
    "pairs": f"select * from (values {_VALUES([(r[0], *p.split(':')) for r in LANGUAGES for p in r[6].split()])}) v(language, acquire_name, release_name)",
    "node_service": "select n.node_id, n.file_id, n.name, min(service) as service from nodes n left join members m on m.file_id = n.file_id group by all",
}
_REL = "('self', 'Self', 'this', 'cls', 'super', 'crate')"
PARTS |= {
    "tcalls": f"select c.*, x.path, x.family, x.language, x.is_typed, x.package_scoped from calls c join files x on x.file_id = c.file_id where {TEST_PATH('x.path')} or c.test_ctx or {TEST_NAME('c.caller')}",
    "own_types": "select name as ty from types union select owner from funcs where owner is not null",
    "defs": f"select f.node_id, f.name, f.owner, f.file_id, x.family, {_DIR('x.path')} as dir from funcs f join files x on x.file_id = f.file_id",
    # each call on its own: definitions it could mean, then the first rung of evidence that fits
    "tcalls_n": f"select *, row_number() over () as cid, list_filter({_SEGS("coalesce(qualifier, '')")}, lambda x: x not in {_REL}) as segs from tcalls",
    "tcand": f"""select t.cid, d.node_id, d.owner = t.recv_type as method, d.file_id = t.file_id as same_file, t.package_scoped and d.dir = {_DIR('t.path')} as same_dir, exists (select 1 from imported i where i.file_id = t.file_id and i.name = t.name and i.target = d.file_id) as imp,
  exists (select 1 from aliases a where a.file_id = d.file_id and list_contains(t.segs, a.alias)) as named from tcalls_n t join defs d on d.name = t.name and d.family = t.family""",
    "tstate": """select t.*, coalesce(recv_type is not null and recv_type not in (select ty from own_types), false) as alien, len(segs) > 0 as qualified, exists (select 1 from aliases a where list_contains(t.segs, a.alias)) as inside,
  coalesce(k.nm, 0) as nm, coalesce(k.ns, 0) as ns, coalesce(k.nd, 0) as nd, coalesce(k.ni, 0) as ni, coalesce(k.nq, 0) as nq, coalesce(k.n, 0) as n
  from tcalls_n t left join (select cid, count(*) filter (method) as nm, count(*) filter (same_file) as ns, count(*) filter (same_dir) as nd, count(*) filter (imp) as ni, count(*) filter (named) as nq, count(*) as n from tcand group by cid) k on k.cid = t.cid""",
    "trung": """select *, case when alien then -1 when nm > 0 then 0 when qualified and not inside then -1 when not qualified and ns > 0 then 1 when not qualified and nd > 0 then 2 when not qualified and ni = 1 then 3 when qualified and nq = 1 then 4 when not qualified and not is_typed and n = 1 then 5 end as rung from tstate""",
    "thits": "select r.*, c.node_id from trung r join tcand c on c.cid = r.cid and case r.rung when 0 then c.method when 1 then c.same_file when 2 then c.same_dir when 3 then c.imp when 4 then c.named when 5 then true else false end",
    "tests_of": f"""select node_id, test, file, line, language, list_extract(['receiver-type', 'same-file', 'same-package', 'import', 'qualifier', 'name-only'], rung + 1) as evidence, (row_number() over (partition by node_id order by rung, file, test, line))::int as rank
  from (select h.node_id, h.caller as test, h.path as file, coalesce((select f.line from funcs f where f.file_id = h.file_id and f.name = h.caller order by f.node_id limit 1), h.line) as line, h.language, min(rung) as rung from thits h where h.caller <> '<top>' group by all)""",
}
PARTS |= {
    "links": "select distinct src, dst from edges where src <> dst",
    "reaches": "select src as a, dst as b from links union select r.a, l.dst from reaches r join links l on l.src = r.b",
    "scc": "select a as node_id, greatest(a, max(b)) as cycle from (select x.a, x.b from reaches x join reaches y on y.a = x.b and y.b = x.a where x.a <> x.b) group by a",
    "comp": "select n.node_id, coalesce(s.cycle, n.node_id) as c from nodes n left join scc s on s.node_id = n.node_id",
    "dag": "select distinct a.c as a, b.c as b from edges e join comp a on a.node_id = e.src join comp b on b.node_id = e.dst where a.c <> b.c",
    "ways": "select distinct c, 0 as len from comp union select d.a, w.len + 1 from ways w join dag d on d.b = w.c",
    "depths": "select c, max(len) as depth from ways group by c",
}
_UNION = lambda q: f"coalesce((select list_sort(list(distinct service)) from {q}), [])"
PARTS |= {
    "def_sv": "select distinct f.name, m.service from funcs f join members m on m.file_id = f.file_id",
    "meth_sv": "select distinct f.owner, f.name, m.service from funcs f join members m on m.file_id = f.file_id where f.owner is not null",
    "type_sv": "select distinct t.name, m.service from types t join members m on m.file_id = t.file_id",
    "word_sv": f"""select distinct word, service from (select file_id, {_STEM("path")} as word from files union all select file_id, regexp_extract({_DIR("path")}, '([^/]*)$', 1) from files where {_STEM("path")} in ('__init__', 'index', 'mod', 'lib') union all select file_id, name from types union all select file_id, name from modules) w join members m on m.file_id = w.file_id where word <> ''""",
    "imp_sv": "select distinct i.file_id, i.names, w.service from imps i join word_sv w on list_contains(i.segs, w.word) or list_contains(i.names, w.word)",
    "bound_sv": "select distinct file_id, unnest(names) as name, service from imp_sv",
    "whole_sv": "select distinct file_id, service from imp_sv where len(names) = 0",
    "qual_sv": f"select distinct qualifier, service from (select qualifier, unnest({_SEGS('qualifier')}) as seg from (select distinct qualifier from calls where qualifier is not null)) q join (select word, service from word_sv union select service, service from members) w on w.word = q.seg",
    "kcalls": "select distinct m.service, c.file_id, c.name, c.qualifier, c.recv_type, x.is_typed from calls c join members m on m.file_id = c.file_id join files x on x.file_id = c.file_id",
    "klists": f"""select k.*, {_UNION("meth_sv s where s.owner = k.recv_type and s.name = k.name and s.service <> k.service")} as t, exists (select 1 from def_sv d where d.name = k.name) as known, {_UNION("def_sv d where d.name = k.name and d.service <> k.service")} as e,
  {_UNION("qual_sv q where q.qualifier = k.qualifier")} as ql, {_UNION("bound_sv b where b.file_id = k.file_id and b.name = k.name")} as bl, {_UNION("whole_sv w where w.file_id = k.file_id")} as wl from kcalls k""",
    "ksteps": "select service, file_id, name, qualifier, recv_type, known, e, [t, list_sort(list_intersect(e, ql)), list_sort(list_intersect(e, bl)), list_sort(list_intersect(e, wl)), case when not is_typed and len(e) = 1 then e else [] end] as steps from klists",
    # the first step that leaves anything; the first one is tried whether or not the name is known
    "kfirst": "select *, coalesce(list_position(list_transform(steps, lambda x: len(x) > 0), true), 0) as pos from ksteps",
    "resolved": """select service, file_id, name, qualifier, recv_type, case when live and len(steps[pos]) = 1 then steps[pos][1] end as target, case when live and len(steps[pos]) = 1 then ['receiver-type', 'qualifier', 'import', 'import', 'name-only'][pos] end as via,
  case when live and len(steps[pos]) = 1 then null when live then 'ambiguous' when not known then 'undefined' when len(e) = 0 then 'local' when len(e) > 1 then 'ambiguous' else 'no-evidence' end as reason,
  case when live and len(steps[pos]) = 1 then [] when live then steps[pos] when not known or len(e) = 0 then [] else e end as candidates from (select *, pos = 1 or (pos > 1 and known and len(e) > 0) as live from kfirst)""",
    "rcalls": "select r.*, c.line, x.path from resolved r join calls c on c.file_id = r.file_id and c.name = r.name and c.qualifier is not distinct from r.qualifier and c.recv_type is not distinct from r.recv_type join files x on x.file_id = r.file_id",
    "mentions": "select f.file_id, x.path, f.line, unnest([regexp_extract(ret, '^(?:Result|Option)<([^,>]*)', 1), case when ret not like '%<%' then ret end, owner]) as symbol from funcs f join files x on x.file_id = f.file_id where x.is_typed",
    "trefs": "select m.service as src, any_value(t.service) as dst, n.symbol, n.path, n.line from mentions n join members m on m.file_id = n.file_id join type_sv t on t.name = n.symbol and t.service <> m.service where n.symbol <> '' group by m.service, n.symbol, n.path, n.line, n.file_id having count(distinct t.service) = 1",
    "met_symbols": """select service as src, target as dst, name as symbol, path, line, via, 'call' as kind, case via when 'receiver-type' then 1 when 'qualifier' then 2 when 'import' then 4 else 6 end as strength from rcalls where target is not null
  union all select src, dst, symbol, path, line, 'type-reference', 'type', 5 from trefs""",
    "symbols": "select src, dst, symbol, path, line, via, kind from (select *, row_number() over (partition by src, dst order by fk, fp, fl, fv, symbol) as n from (select *, row_number() over (partition by src, dst, symbol order by strength, kind, path, line, via) as rn, first_value(kind) over w as fk, first_value(path) over w as fp, first_value(line) over w as fl, first_value(via) over w as fv from met_symbols window w as (partition by src, dst, symbol order by kind, path, line, via)) where rn = 1) where n <= 100",
    "evident_edges": "select coalesce(s.src, d.src) as src, coalesce(s.dst, d.dst) as dst, d.src is not null as declared, s.src is not null as detected, coalesce(n, 0)::bigint as symbols from (select src, dst, count(*) as n from symbols group by 1, 2) s full join deps d on d.src = s.src and d.dst = s.dst",
    "ann": "select a.*, x.path, lower(trim(key)) as k, row_number() over () as aid from annotations a join files x on x.file_id = a.file_id",
    "met_ann": "select c.aid, c.key, case when c.transport <> 'unspecified' then c.transport else s.transport end as transport, coalesce(c.own, '') as src, coalesce(s.service, '') as dst, c.path, c.line, c.function, s.path as remote_path, s.line as remote_line from (select ann.*, (select min(service) from members m where m.file_id = ann.file_id) as own from ann where boundary = 'calls') c join (select ann.*, m.service from ann left join members m on m.file_id = ann.file_id where boundary = 'serves') s on s.k = c.k and coalesce(c.own, '') <> coalesce(s.service, '')",
    "sites": "select key, transport, src, dst, path, line, function, remote_path, remote_line, false as external from met_ann union all select key, transport, coalesce((select min(service) from members m where m.file_id = ann.file_id), ''), '', path, line, function, null, null, false from ann where boundary = 'calls' and aid not in (select aid from met_ann)",
}
PARTS["aliases"] = PARTS["aliases"].replace("""
  and not (alias in ('src', 'pkg', 'internal', 'cmd', 'app', 'lib', 'test', 'tests', 'include') and alias not in (select 'none'))""", "").replace(f"unnest(string_split({_DIR('path')}, '/')) from files", f"d from (select file_id, unnest(string_split({_DIR('path')}, '/')) as d from files) where d not in ('src', 'pkg', 'internal', 'cmd', 'app', 'lib', 'test', 'tests', 'include')")


def build(sql: str, **extra: str) -> str:
    """``sql`` with all the parts it names, directly or through others, as common table expressions."""
    parts, done, out = PARTS | extra, set(), []

    def need(text: str) -> None:
        for w in re.findall(r"[a-z_][a-z_0-9]*", text):
            if w in parts and w not in done:
                done.add(w)
                need(parts[w])
                out.append(f"{w} as materialized ({parts[w]})")

    need(sql)
    loops = [w for w in done if re.search(rf"\b(from|join) {w}\b", parts[w])]
    for w in loops:
        out = [x.replace(f"{w} as materialized (", f"{w} as (", 1) if x.startswith(f"{w} as materialized (") else x for x in out]
    return ("with recursive " if loops else "with ") + ",\n".join(out) + "\n" + sql if out else sql
