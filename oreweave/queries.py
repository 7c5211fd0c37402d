"""Queries over the driver's tables, one or more for each operator, and SQL with the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import columns as C
from .functions import python as P
from .operators import callgraph, constants, debuginfo, headers, labels, linking, prompts, selection
from .plans import fixed
from .plans.store import shared_dir
from .sources import ingest, tools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BUDGET = 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("as string)", "as varchar)")
        return f

    return add


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


JUNK, RUNTIME = _list(fixed.JUNK_FUNCTIONS), _list(fixed.RUNTIME_ENTRY_FUNCTIONS)
NB = "nb as (select src n, dst f, 'caller' as role from ed union all select dst, src, 'callee' from ed)"
HOPS = f"""with {A.FN_SQL}, {A.EDGE_SQL}, {NB},
l1 as (select distinct n as t, f, role from nb where f <> n),
fr as (select distinct t, f as n from l1),
l2 as (select distinct fr.t, nb.f, nb.role from fr join nb on nb.n = fr.n left join fr o on o.t = fr.t and o.n = nb.f where nb.f <> fr.t and not (o.n is not null and nb.f < fr.n)),
al as (select t, f, role, min(d) as degree from (select *, 1 as d from l1 union all select *, 2 from l2) group by all),
dd as (select t, f, role, degree from (select *, row_number() over (partition by t, f order by case role when 'caller' then 0 else 1 end) as rn from al) where rn = 1)"""
CAND = f"""{HOPS},
kept as (select t, f, role, degree, name, token_count from dd join fn on addr = f
  where name is not null and name <> '' and (t = f or name = 'main' or not (name in ({RUNTIME}) or is_plt or name like '\\_\\_%' escape '\\' or (n_blocks <= 2 and n_insns <= 8)))),
nj as (select src, count(*) as n from ed join fn on addr = dst where name not in ({JUNK}) group by src),
ca as (select kept.*, kept.f not in (select src from ed) as is_leaf, coalesce(nj.n, 0) as n_callees, exists (select 1 from ed where src = kept.f and dst = kept.t) as calls_target from kept left join nj on nj.src = kept.f),
sc as (select *, ((100.0::double + case when calls_target then 30 else 0 end) - n_callees * 5.0::double) - (degree - 1) * 10.0::double - token_count / 100.0::double as score, case role when 'caller' then 0 else 1 end as r from ca)"""
FOLD = """list_reduce({list}, lambda a, x: case when a.b > 0 and x.tok <= a.b then {{'b': a.b - x.tok, 'ids': list_append(a.ids, x.f), 'tok': 0::bigint, 'f': 0::bigint}} else a end, {start})"""
ROW = "{'b': %s::bigint, 'ids': []::bigint[], 'tok': 0::bigint, 'f': 0::bigint}"


def _found(spark, d):
    return callgraph.neighbours(A.edges(spark, d))


def _graph(spark, d):
    return A.functions(spark, d), A.edges(spark, d)


def _cands(spark, d, *columns):
    return selection.candidates(*_graph(spark, d), columns=columns)


# ingest and sources


@query(f"with {A.REPO_SQL} select replace(repo_name, '/', '_') as repo, file_path as path, file_content as content from (select *, row_number() over (partition by repo_name, file_path order by doc_id desc) as n from rf) where n = 1")
def ingest_explode_dedup(spark, d):
    return ingest.last_writes(ingest.files_of(A.repo_files(spark, d))).select("repo", "path", "content")


@query(f"with {A.SRC_SQL} select page_id, regexp_replace(content, '#include\\s*<(.*?)>', '#include \"\\1\"', 'g') as content from src")
def include_rewrite(spark, d):
    return A.sources(spark, d).select("page_id", C.quote_includes(F.col("content")).alias("content"))


@query(f"with {A.REPO_SQL} select distinct repo_name, replace(repo_name, '/', '_') as repo from rf")
def repo_sanitise(spark, d):
    return A.repo_files(spark, d).select("repo_name", C.repo_key(F.col("repo_name")).alias("repo")).distinct()


@query(f"with {A.REPO_SQL} select distinct replace(repo_name, '/', '_') as repo from rf where replace(repo_name, '/', '_') >= 'src3'")
def repo_listing(spark, d):
    return ingest.repositories(ingest.files_of(A.repo_files(spark, d)), "src3")


@query("""select page_id, 'C_COMPILE/' || regexp_replace(url, '[:?#].*$', '') || '/p' || page_id || '.tar.c' as c_path,
  'COMPILED/' || regexp_replace(url, '[:?#].*$', '') || '/p' || page_id || '.tar.o' as o_path, 'C_COMPILE/' || regexp_replace(url, '[:?#].*$', '') || '/p' || page_id || '.tar.c' as back from pages""")
def path_mirror(spark, d):
    made = A.sources(spark, d).select("page_id", F.concat(F.lit("C_COMPILE/"), F.regexp_replace("url", "[:?#].*$", ""), F.lit("/p"), F.col("page_id"), F.lit(".tar.c")).alias("c_path"))
    made = made.withColumn("o_path", C.mirrored(F.col("c_path"), F.lit("C_COMPILE/"), F.lit("COMPILED/"), ".o"))
    return made.withColumn("back", C.mirrored(F.col("o_path"), F.lit("COMPILED/"), F.lit("C_COMPILE/"), ".c"))


@query("select page_id, 'a/' || page_id || '/c' as path, page_id % 3 = 0 as is_escaping from pages where page_id % 3 <> 0 union all select page_id, '../' || page_id, true from pages where page_id % 3 = 0")
def path_normalise(spark, d):
    raw = A.sources(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x/../../"), F.col("page_id"))).otherwise(F.concat(F.lit("./a//"), F.col("page_id"), F.lit("/b/../c"))).alias("p"))
    return raw.select("page_id", P.normal_path("p").alias("path")).withColumn("is_escaping", F.col("path").startswith("../"))


@query(f"with {A.REPO_SQL} select distinct replace(repo_name, '/', '_') as repo, replace(repo_name, '/', '_') || '/d' as dir from rf")
def include_dirs(spark, d):
    return ingest.include_dirs(ingest.files_of(A.repo_files(spark, d)))


UNIT_SQL = f"""{A.REPO_SQL}, u as (select distinct replace(repo_name, '/', '_') as repo, 'S/' || replace(repo_name, '/', '_') || '/' || file_path as c_path, 'O/' || replace(repo_name, '/', '_') || '/' || regexp_replace(file_path, '[.]c$', '.o') as o_path from rf),
v as (select *, 'ulimit -f 5242880 && timeout 60 gcc -c -gdwarf -O1 -o "' || o_path || '" "' || c_path || '" -I"S/' || repo || '/d"' as cmd from u)"""


def _units(spark, d, most=fixed.ARG_MAX):
    return ingest.compile_units(ingest.last_writes(ingest.files_of(A.repo_files(spark, d))), "S", "O", most)


@query(f"with {UNIT_SQL} select repo, c_path, o_path, cmd from v")
def compile_command(spark, d):
    return _units(spark, d).select("repo", "c_path", "o_path", "cmd")


@query(f"with {UNIT_SQL} select c_path, length(cmd) > 112 as skipped from v")
def argmax_filter(spark, d):
    return _units(spark, d, 112).select("c_path", "skipped")


@query(f"with {A.SRC_SQL} select page_id, case when page_id % 2 = 0 then '//gcc -c p' || page_id || chr(10) || content else content end as content from src")
def provenance_prefix(spark, d):
    made = A.sources(spark, d)
    return made.select("page_id", C.with_provenance(F.col("content"), F.concat(F.lit("gcc -c p"), F.col("page_id")), F.col("page_id") % 2 == 0).alias("content"))


@query(f"select replace(source || '/' || lang, '/', '_') as repo, 'd/' || doc_id || '.c' as path, text as content from documents where text is not null and source is not null and lang is not null and not ({A.BROKEN})")
def jsonl_ingest(spark, d):
    """A compressed dump is written, read line by line and parsed; broken lines fall out."""
    path = f"{shared_dir(spark)}/oreweave-dump-{uuid.uuid4().hex}"
    A.dump_lines(spark, d).write.option("compression", "gzip").text(path)
    return ingest.last_writes(ingest.files_of(ingest.parse_lines(ingest.read_lines(spark, path)))).select("repo", "path", "content")


@query("select 's' || s_suppkey as repo from supplier where s_suppkey >= 5")
def repo_resume(spark, d):
    listing = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("repo"), F.col("s_suppkey").alias("listed"))
    return ingest.resume_from(listing, "s5").select("repo")


@query("select s_suppkey as unit, (s_suppkey % 3)::int as rc, case when s_suppkey % 3 = 1 then 'bad' || chr(10) else '' end as stderr from supplier where s_suppkey % 4 <> 0 union all select s_suppkey, null, null from supplier where s_suppkey % 4 = 0")
def command_runs(spark, d):
    """Real commands, every fourth one too long and skipped."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    cmds = s.selectExpr("s_suppkey as unit", "case when s_suppkey % 3 = 1 then 'echo bad >&2; ' else '' end || 'exit ' || (s_suppkey % 3) as cmd", "s_suppkey % 4 = 0 as skipped")
    return tools.run_commands(cmds).select("unit", "rc", "stderr")


@query("""select cast(o_custkey % 150 as varchar) as repo, 'gcc ' || o_orderkey || chr(10) || o_orderkey || '.c' || chr(10) || 'error ' || o_orderpriority as entry from orders where o_orderkey % 7 = 0""")
def error_log(spark, d):
    runs = spark.read.parquet(f"{d}/orders.parquet").selectExpr("cast(o_custkey % 150 as string) as repo", "'gcc ' || o_orderkey as cmd", "o_orderkey || '.c' as c_path", "'error ' || o_orderpriority as stderr", "case when o_orderkey % 7 = 0 then 1 when o_orderkey % 7 < 5 then 0 end as rc")
    return tools.error_log(runs)


# linking


@query(f"with {A.SYM_SQL} select repo, obj as o_path, rank() over (partition by repo, obj order by s)::int as pos, st as sym_type, s as name from sy")
def nm_symbols(spark, d):
    return linking.symbol_rows(A.nm_lines(spark, d))


@query(f"with {A.SYM_SQL} select obj as o_path, coalesce(string_agg(s, ',' order by s) filter (where st = 'U'), '') as u_syms, coalesce(string_agg(s, ',' order by s) filter (where st = 'T'), '') as t_syms from sy group by repo, obj")
def symbol_lists(spark, d):
    out = linking.symbol_lists(A.symbols(spark, d))
    return out.select("o_path", F.array_join("u_syms", ",").alias("u_syms"), F.array_join("t_syms", ",").alias("t_syms"))


@query(f"with {A.SYM_SQL} select obj as o_path, bool_or(s = 'main') as is_main from sy group by repo, obj")
def is_main(spark, d):
    return linking.symbol_lists(A.symbols(spark, d)).select("o_path", "is_main")


LINK = f"""with recursive {A.SYM_SQL},
m as (select distinct repo, obj from sy where s = 'main'),
e as (select distinct u.repo, u.obj as a, t.obj as b from sy u join sy t on u.repo = t.repo and u.s = t.s and u.st = 'U' and t.st = 'T' and u.obj <> t.obj left join m on m.repo = t.repo and m.obj = t.obj where t.s <> 'main' and (m.obj is null or t.s < 'main')),
r as (select m.repo, m.obj as root, e.b as obj from m join e on e.repo = m.repo and e.a = m.obj union select r.repo, r.root, e.b from r join e on e.repo = r.repo and e.a = r.obj)"""
PROGRAMS = f"""{LINK}, p as (select m.repo, m.obj as main_o, row_number() over (partition by m.repo order by m.obj) - 1 as i, coalesce(g.o, '') as objects, coalesce(g.own, false) as root_in_closure
  from m left join (select repo, root, string_agg(obj, ' ' order by obj) as o, bool_or(obj = root) as own from r group by all) g on g.repo = m.repo and g.root = m.obj)"""


@query(f"{LINK} select repo, a, b from e")
def link_edges(spark, d):
    return linking.link_edges(A.symbols(spark, d))


@query(f"{LINK} select repo, root, obj from r")
def link_closure(spark, d):
    return linking.link_closure(A.symbols(spark, d))


@query(f"{PROGRAMS} select repo, i::int as program_index, main_o, objects, root_in_closure, 'gcc -o ' || repo || '/executable' || i || ' ' || main_o || ' ' || objects as cmd from p")
def link_programs(spark, d):
    return linking.plans(A.symbols(spark, d)).withColumn("objects", F.array_join("objects", " "))


@query(f"""{PROGRAMS}, w as (select distinct repo, i, o from (select repo, i, main_o as o from p union all select repo, i, unnest(string_split(objects, ' ')) from p) where o <> '')
select repo, o as o_path, 'int x;' || chr(10) || chr(10) || '//' || string_agg('executable' || i, ', ' order by i) as content from w group by all""")
def program_tags(spark, d):
    """Sources of all objects; those of no program stay as they are and are left out."""
    s = A.symbols(spark, d)
    sources = s.select("repo", "o_path").distinct().withColumn("content", F.lit("int x;\n"))
    return linking.tagged_by_symbols(sources, s).filter("content <> 'int x;\n'")


@query("select cast(o_custkey % 150 as varchar) as repo, count(*) as runs, count(*) filter (where o_orderkey % 7 <> 0) as successes from orders group by 1")
def success_counts(spark, d):
    return linking.success_counts(spark.read.parquet(f"{d}/orders.parquet").selectExpr("cast(o_custkey % 150 as string) as repo", "case when o_orderkey % 7 = 0 then 1 else 0 end as rc"))


# call graph and candidates


@query(f"with {A.FN_SQL}, {A.EDGE_SQL}, {NB} select distinct n as target, f as addr, role, 1 as degree from nb where f <> n")
def neighbours_1(spark, d):
    return callgraph.neighbours(A.edges(spark, d), 1).select("target", "addr", "role", "degree")


@query(f"{HOPS} select t as target, f as addr, role, degree from al")
def neighbours_k(spark, d):
    return _found(spark, d).select("target", "addr", "role", "degree")


@query(f"{HOPS} select t as target, f as addr, role, degree from dd")
def candidates_dedup(spark, d):
    return callgraph.nearest(callgraph.hops(A.edges(spark, d))).select("target", "addr", "role", "degree")


@query(f"{HOPS} select t as target, count(*) filter (where role = 'caller') as n_callers, count(*) filter (where role = 'callee') as n_callees from al group by t")
def role_counts(spark, d):
    return callgraph.counted(A.edges(spark, d)).select("target", "n_callers", "n_callees")


@query(f"{CAND} select t as target, f as addr, role, degree, name, token_count from kept")
def candidates_filtered(spark, d):
    return _cands(spark, d, "addr", "role", "degree", "name", "token_count").drop("binary_id")


@query(f"""{CAND} select t as target, string_agg(name, ',' order by degree, r, f) as func_names, string_agg(f::varchar, ',' order by degree, r, f) as addrs, sum(token_count)::bigint as total_token_count from sc group by t""")
def candidate_bundle(spark, d):
    out = selection.bundles_of(*_graph(spark, d))
    return out.select("target", F.array_join("func_names", ",").alias("func_names"), F.array_join(F.col("addrs").cast("array<string>"), ",").alias("addrs"), "total_token_count")


@query(f"with {A.FN_SQL}, {A.EDGE_SQL} select addr, addr not in (select src from ed) as is_leaf from fn")
def leaf_flag(spark, d):
    return callgraph.leaf_flags(A.functions(spark, d), A.edges(spark, d)).select("addr", "is_leaf")


@query(f"with {A.FN_SQL}, {A.EDGE_SQL} select fn.addr, coalesce(n, 0) as n_callees from fn left join (select src, count(*) as n from ed join fn on addr = dst where name not in ({JUNK}) group by src) on src = addr")
def nonjunk_callees(spark, d):
    return callgraph.callee_counts(A.functions(spark, d), A.edges(spark, d)).select("addr", "n_callees")


@query(f"{CAND} select t as target, f as addr, calls_target from ca")
def calls_target(spark, d):
    return _cands(spark, d, "addr", "calls_target").drop("binary_id")


@query(f"{CAND} select t as target, f as addr, score from sc")
def candidate_score(spark, d):
    return _cands(spark, d, "addr", "score").drop("binary_id")


@query(f"with {A.FN_SQL} select addr, name from fn where name not in ({JUNK})")
def junk_filter(spark, d):
    return callgraph.without_junk(A.functions(spark, d)).select("addr", "name")


@query(f"with {A.FN_SQL} select min(addr) as target from fn where name = 'printf' having count(*) > 0")
def target_lookup(spark, d):
    return callgraph.target_named(A.functions(spark, d), "printf").select("target")


@query("with e as (select distinct l_suppkey as f, l_linenumber as a, l_quantity::int % 7 as b from lineitem) select f as func_addr, (select count(distinct x) from (select a as x from e i where i.f = e.f union all select b from e i where i.f = e.f))::int as cfg_nodes, count(*)::int as cfg_edges from e group by f")
def flow_metrics(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("'b' as binary_id", "l_suppkey as func_addr", "l_linenumber as src", "cast(l_quantity as int) % 7 as dst")
    return callgraph.flow_metrics(rows).select("func_addr", "cfg_nodes", "cfg_edges")


# selection


@query(f"{CAND}, w as (select t, min(degree) as m from sc group by t) select w.t as target, m as min_degree, sum(token_count)::bigint as level_tokens from w join sc on sc.t = w.t and degree = m group by all")
def degree_level(spark, d):
    return selection.degree_levels_of(*_graph(spark, d)).select("target", "min_degree", "level_tokens")


@query(f"{CAND} select t as target, string_agg(f::varchar, ',' order by n) as addrs from (select t, f, row_number() over (partition by t order by -score, degree, r, f) as n from sc) where n <= 5 group by t")
def top5_important(spark, d):
    return selection.important_of(*_graph(spark, d)).select("target", F.array_join(F.col("addrs").cast("array<string>"), ",").alias("addrs"))


LISTS = """li as (select t, list({'b': 0::bigint, 'ids': []::bigint[], 'tok': token_count, 'f': f} order by -score, token_count, degree, r, f) as s0, list({'b': 0::bigint, 'ids': []::bigint[], 'tok': token_count, 'f': f} order by -score, degree, r, f) as s1 from sc group by t)"""
SELECTED = f"""{CAND}, {LISTS},
ta as (select addr as t, {BUDGET} - token_count as left_, case when {BUDGET} - token_count <= 0 then null when {BUDGET} - token_count <= {BUDGET * 0.25} then 2 when {BUDGET} - token_count <= {BUDGET * 0.6} then 1 else 0 end as level from fn),
a1 as (select ta.t, left_, level, s0, case when level = 1 and s1 is not null then {FOLD.format(list=f"list_filter(s1[1:5], lambda x: x.tok <= {BUDGET // 2})", start=ROW % "left_")} else {ROW % "left_"} end as one from ta left join li on li.t = ta.t),
se as (select t, level, case when left_ <= 0 then 'no_budget' when level = 2 then 'level2_unimplemented' else 'ok' end as status, case when level in (0, 1) and s0 is not null then ({FOLD.format(list="list_filter(s0, lambda x: not list_contains(one.ids, x.f))", start="one")}).ids else []::bigint[] end as ids from a1)"""


@query(f"{CAND}, {LISTS} select fn.addr as target, array_to_string(case when s0 is null then []::bigint[] else ({FOLD.format(list='s0', start=ROW % '(100000 - token_count)')}).ids end, ',') as picked from fn left join li on t = addr")
def greedy_select_l0(spark, d):
    out = selection.context_of(*_graph(spark, d), 100_000)
    return out.select("target", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"))


@query(f"{SELECTED} select t as target, level::int as level, status, array_to_string(ids, ',') as picked from se")
def select_context(spark, d):
    out = selection.context_of(*_graph(spark, d), BUDGET)
    return out.select("target", "level", "status", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"))


@query(f"{CAND}, g as (select t, degree, list({{'b': 0::bigint, 'ids': []::bigint[], 'tok': token_count, 'f': f}} order by f) as xs from sc group by all) select t as target, degree, array_to_string(({FOLD.format(list='xs', start=ROW % '1500')}).ids, ',') as picked from g")
def degree_group_fold(spark, d):
    return selection.groups_of(*_graph(spark, d), 1500).select("target", "degree", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"))


PICKED = f"{SELECTED}, pi as (select t, level, unnest(ids) as f, unnest(range(len(ids))) as sel_ord from se)"


@query(f"{PICKED} select pi.t as target, sel_ord::int as sel_ord, pi.f as addr, role, degree, name, token_count from pi join sc on sc.t = pi.t and sc.f = pi.f")
def selected_rows(spark, d):
    return selection.picked_of(*_graph(spark, d), BUDGET).select("target", "sel_ord", "addr", "role", "degree", "name", "token_count")


@query(f"with {A.FN_SQL} select addr, case when cfg_nodes = 0 then 1.0::double else (cfg_edges * 1.5::double + cfg_nodes * 1.0::double) * 5.0::double end as c_size from fn")
def c_size_estimate(spark, d):
    return A.functions(spark, d).select("addr", C.c_size_estimate(F.col("cfg_nodes"), F.col("cfg_edges")).alias("c_size"))


@query(f"with {A.FN_SQL} select addr, n_blocks <= 2 and n_insns <= 8 as is_tiny from fn")
def tiny_filter(spark, d):
    return A.functions(spark, d).select("addr", C.is_tiny(F.col("n_blocks"), F.col("n_insns")).alias("is_tiny"))


KIND = "case when " + " or ".join(f"contains(lower(text), '{w}')" for w in fixed.COMMAND_WORDS) + f" then 'CMD' when regexp_matches(text, '{fixed.FORMAT_PATTERN}') then 'FMT' else 'STR' end"
BLOB = f"case when length(regexp_replace(text, '[^\\x09\\x0a\\x0d\\x20-\\x7e]', '', 'g'))::double / octet_length(encode(text)) >= 0.7 then {KIND} else 'DAT' end"

# listings, headers, prompts

LISTING = "b as (select conv_id, string_agg(';;; Block @ 0x' || lower(to_hex(turn * 16 + 4096)) || chr(10) || text, chr(10) order by turn) as assembly from conversations where text is not null group by conv_id)"


@query(f"with {LISTING} select conv_id as func_addr, assembly from b")
def assembly_listing(spark, d):
    return prompts.listings(A.blocks(spark, d)).select("func_addr", "assembly")


INSNS = "';;; Block @ 0x1000' || chr(10) || 'push rbp' || chr(10) || 'mov eax, ' || p_size || case when p_partkey % 5 <> 0 then chr(10) || ';;; Block @ 0x1010' || chr(10) || 'call ' || p_partkey else '' end || chr(10) || ';;; Block @ 0x1020' || chr(10) || 'ret'"


@query(f"select p_partkey as func_addr, {INSNS} as assembly from part")
def insn_listing(spark, d):
    return prompts.listings(A.insn_blocks(spark, d)).select("func_addr", "assembly")


@query(f"with {A.FN_SQL}, i as (select p_partkey as addr, {INSNS} as assembly from part) select fn.addr, name, coalesce(i.assembly, '') as assembly, coalesce(len(regexp_extract_all(i.assembly, '\\S+')), 0) as token_count from fn left join (select * from i where addr % 9 <> 0) i using (addr)")
def function_records(spark, d):
    """Every ninth function has no listing."""
    listed = prompts.listings(A.insn_blocks(spark, d)).filter("func_addr % 9 <> 0")
    return prompts.function_data(A.functions(spark, d).drop("token_count"), listed, P.token_counter(lambda: str.split)("assembly")).select("addr", "name", "assembly", "token_count")


@query(f"with {LISTING} select conv_id as func_addr, len(regexp_extract_all(assembly, '\\S+')) as token_count from b")
def token_count(spark, d):
    return prompts.listings(A.blocks(spark, d)).select("func_addr", P.token_counter(lambda: str.split)("assembly").alias("token_count"))


UNDEF = f"{A.UNDEF_SQL}, ex as (select distinct binary_id, sym as symbol from un where sym not like '\\_\\_%' escape '\\')"
HEADERS = "hm as (select * from (values " + ", ".join(f"({i}, '{h}', '{s}')" for i, (h, ss) in enumerate(fixed.HEADER_MAP.items()) for s in ss) + ") as t(header_ord, header, symbol)), nh as (select distinct binary_id, header_ord, header from ex join hm using (symbol))"


@query(f"with {UNDEF} select binary_id, symbol from ex")
def undef_symbols(spark, d):
    return headers.external_symbols(A.readelf_lines(spark, d))


@query(f"with {UNDEF}, {HEADERS} select binary_id, header_ord, header from nh")
def needed_headers(spark, d):
    return headers.needed_headers(headers.external_symbols(A.readelf_lines(spark, d)))


@query(f"with {UNDEF}, {HEADERS} select u.binary_id, coalesce('HEADERS:' || chr(10) || g.t || chr(10), '') as header_block from (select distinct binary_id from un) u left join (select binary_id, string_agg('#include ' || header, chr(10) order by header_ord) as t from nh group by binary_id) g using (binary_id)")
def header_block(spark, d):
    lines = A.readelf_lines(spark, d)
    return headers.header_blocks(lines, headers.external_symbols(lines))


def _prompt_parts(spark, d):
    code = lambda addr: F.concat(F.lit(" mov "), addr.cast("string"), F.lit("\nret "))
    context = selection.picked_of(*_graph(spark, d), BUDGET).withColumn("assembly", F.when(F.col("addr") % 9 != 0, code(F.col("addr"))))
    targets = A.functions(spark, d).withColumnRenamed("addr", "target").withColumn("assembly", code(F.col("target")))
    block = spark.createDataFrame([("b", "HEADERS:\n#include <stdio.h>\n")], "binary_id string, header_block string")
    return targets, context, block


BODY = "'mov ' || {0} || chr(10) || 'ret'"
PROMPT = f"""{PICKED}, co as (select t, role, name, f, row_number() over (partition by t, role, name order by sel_ord) as n, sel_ord from (select pi.t, pi.f, sel_ord, role, name from pi join sc on sc.t = pi.t and sc.f = pi.f where pi.f % 9 <> 0)),
bl as (select t, string_agg('Caller: ' || name || chr(10) || {BODY.format("f")}, chr(10) || chr(10) order by sel_ord) filter (where role = 'caller') as c1, string_agg('Callee: ' || name || chr(10) || {BODY.format("f")}, chr(10) || chr(10) order by sel_ord) filter (where role = 'callee') as c2 from co where n = 1 group by t),
pr as (select addr as target, name, 'HEADERS:' || chr(10) || '#include <stdio.h>' || chr(10) || chr(10) || 'Target: ' || name || chr(10) || {BODY.format("addr")} || case when c1 is not null then chr(10) || chr(10) || 'BY' || chr(10) || chr(10) || c1 else '' end || case when c2 is not null then chr(10) || chr(10) || 'TO' || chr(10) || chr(10) || c2 else '' end || chr(10) as model_input from fn left join bl on bl.t = addr)"""


@query(f"{PROMPT} select target, model_input from pr")
def prompt_build(spark, d):
    return prompts.prompts(*_prompt_parts(spark, d)).select("target", "model_input")


@query(f"""{PICKED}, le as (select pi.t, string_agg(';;; Context: ' || name || ' (degree ' || degree || ', role ' || role || ')' || chr(10) || ' mov ' || pi.f || chr(10) || 'ret ', chr(10) || '<SEP>' || chr(10) order by sel_ord) as c from pi join sc on sc.t = pi.t and sc.f = pi.f where pi.f % 9 <> 0 group by pi.t)
select addr as target, coalesce(c, '') || chr(10) || '<TARGET_SEP>' || chr(10) || ';;; Target: ' || name || chr(10) || ' mov ' || addr || chr(10) || 'ret ' as model_input from fn left join le on le.t = addr""")
def legacy_prompt(spark, d):
    targets, context, _ = _prompt_parts(spark, d)
    return prompts.legacy_prompts(targets, context).select("target", "model_input")


@query(f"{PICKED} select pi.t as target, string_agg(';;; Function: ' || name || ' (degree ' || degree || ', role ' || role || ', mode assembly)' || chr(10), '' order by sel_ord) || chr(10) as overview from pi join sc on sc.t = pi.t and sc.f = pi.f group by pi.t")
def context_overview(spark, d):
    return prompts.context_overview(selection.picked_of(*_graph(spark, d), BUDGET)).select("target", "overview")


@query(f"""{PROMPT}, pk as (select pi.t, pi.f, sel_ord, role, degree, name, case when pi.f % 9 <> 0 then ' mov ' || pi.f || chr(10) || 'ret ' else '' end as code from pi join sc on sc.t = pi.t and sc.f = pi.f)
select t as target, 'selected_context_functions.txt' as file, string_agg(';;; Function: ' || name || ' (degree ' || degree || ', role ' || role || ', mode assembly)' || chr(10), '' order by sel_ord) || chr(10) as content from pk group by t
union all select t, 'context_candidate_assembly.txt', string_agg(';;; Function: ' || name || ' (degree ' || degree || ')' || chr(10) || code || chr(10) || chr(10), '' order by sel_ord) from pk group by t
union all select target, 'final_model_input.txt', model_input from pr
union all select addr, 'target_assembly.txt', ' mov ' || addr || chr(10) || 'ret ' from fn""")
def text_files(spark, d):
    targets, context, block = _prompt_parts(spark, d)
    return prompts.text_files(targets, context, prompts.prompts(targets, context, block)).select("target", "file", "content")


@query(f"with {A.LIT_SQL} select addr % 1000 as func_addr, count(*) as n_literals, count(*) filter (where {BLOB} <> 'DAT') as n_named from lit group by 1")
def literal_multimap(spark, d):
    """Literals of each function, gathered and counted."""
    made = constants.classified(A.literals(spark, d).withColumn("bytes", F.encode("text", "UTF-8")).withColumn("func_addr", F.col("addr") % 1000).withColumn("ord", F.lit(0)))
    return labels.pools(made, "func_addr").join(made.groupBy("func_addr").agg(F.count("*").alias("n_literals")), "func_addr").select("func_addr", "n_literals", F.size("pool").cast("long").alias("n_named"))


# constants and labels


@query(f"with {A.LIT_SQL} select addr, length(regexp_replace(text, '[^\\x09\\x0a\\x0d\\x20-\\x7e]', '', 'g'))::double / octet_length(encode(text)) >= 0.7 as printable from lit")
def printable(spark, d):
    return A.literals(spark, d).select("addr", C.is_printable(F.encode("text", "UTF-8")).alias("printable"))


@query(f"with {A.LIT_SQL} select addr, {KIND} as kind from lit")
def classify_literals(spark, d):
    return A.literals(spark, d).select("addr", C.literal_kind(F.col("text")).alias("kind"))


@query(f"with {A.LIT_SQL} select addr, {BLOB} || 'x' || lower(to_hex(addr)) as placeholder from lit")
def placeholders(spark, d):
    return constants.classified(A.literals(spark, d).withColumn("bytes", F.encode("text", "UTF-8"))).select("addr", "placeholder")


SEGMENT = "select p_partkey as k, case p_partkey % 3 when 0 then '%' || p_size || 'd ' || p_name when 1 then p_name else p_name || ';' end as text from part"


@query(f"with s as ({SEGMENT}) select k as func_addr, 0 as ord, 4194304 + k * 64 as addr, text, {KIND} as kind, {KIND} || 'x' || lower(to_hex(4194304 + k * 64)) as placeholder from s")
def const_pool(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    text = F.expr("case p_partkey % 3 when 0 then '%' || p_size || 'd ' || p_name when 1 then p_name else p_name || ';' end")
    segments = part.select(F.lit("b").alias("binary_id"), (F.lit(4194304) + F.col("p_partkey") * 64).alias("vaddr"), F.concat(F.encode(text, "UTF-8"), F.lit(b"\0junk")).alias("bytes"))
    insn = "named_struct('address', 4096, 'size', 7, 'text', 'lea', 'operands', array(named_struct('type', 'REG', 'imm', cast(null as bigint), 'base', cast(null as string), 'disp', cast(null as bigint)), named_struct('type', 'MEM', 'imm', cast(null as bigint), 'base', 'rip', 'disp', 4194304 + p_partkey * 64 - 4103)))"
    blocks = part.selectExpr("'b' as binary_id", "p_partkey as func_addr", "0 as block_ord", "cast(4096 as bigint) as block_addr", f"array({insn}, {insn}) as insns")
    return constants.constant_pool(blocks, segments).select("func_addr", "ord", "addr", "text", "kind", "placeholder")


@query(f"with {A.CSRC_SQL} select addr, replace(content, '\"' || lit || '\"', 'STRx' || lower(to_hex(addr))) as annotated from cs")
def annotate_exact(spark, d):
    pool = F.array(F.struct(F.col("lit").alias("text"), C.placeholder(F.lit("STR"), F.col("addr")).alias("placeholder")))
    return A.c_sources(spark, d).select("addr", labels.annotate_exact(F.col("content"), pool).alias("annotated"))


@query()
def annotate_fuzzy(spark, d):
    pool = F.array(F.struct(F.concat("lit", F.lit("!")).alias("text"), C.placeholder(F.lit("STR"), F.col("addr")).alias("placeholder")))
    made = A.c_sources(spark, d).select("addr", F.col("content").alias("real_src"), pool.alias("pool"))
    return labels.annotate(made).select("addr", "annotated")


@query()
def similar_literals(spark, d):
    made = A.c_sources(spark, d)
    pool = made.select("addr", F.lit(0).alias("ord"), F.concat("lit", F.lit("!")).alias("text"))
    literals = made.select("addr", F.lit(0).alias("literal_ord"), F.col("lit").alias("literal"))
    return labels.pool_matches(pool, literals, "addr").select("addr", "literal", "ratio")


@query(f"with {A.CSRC_SQL} select addr, case when addr % 5 = 0 then '{fixed.NO_LABEL}' when addr % 5 = 1 then 'int f(void);' when addr % 5 = 2 then rtrim(content, chr(10)) else 'int f(void);' || chr(10) || rtrim(content, chr(10)) end as label_c_code from cs")
def final_label(spark, d):
    k = F.col("addr") % 5
    body, sig = F.when(k >= 2, F.col("content")), F.when((k == 1) | (k >= 3), F.lit("int f(void); "))
    return A.c_sources(spark, d).select("addr", labels.final_label(body, sig).alias("label_c_code"))


@query(f"with {A.CSRC_SQL} select addr, rtrim(content, chr(10)) as real_src from cs")
def c_function_extract(spark, d):
    """Each source once with other functions around the wanted one."""
    made = A.c_sources(spark, d)
    funcs = made.select("addr", F.concat(F.lit("/r/COMPILED/p"), "addr", F.lit("/executable0")).alias("binary_path"), "name")
    sources = made.select(F.concat(F.lit("/r/C_COMPILE/p"), "addr", F.lit("/")).alias("dir"), F.lit("a.c").alias("file"), F.concat(F.lit("void g(void) { h(\"}\"); };\n"), "content", F.lit("int k;\n")).alias("content"))
    return labels.real_code(funcs, sources).select("addr", "real_src")


DIE_SQL = f"""with recursive {A.DIE_SQL},
wr as (select *, tag in ('DW_TAG_pointer_type', 'DW_TAG_const_type', 'DW_TAG_volatile_type', 'DW_TAG_restrict_type') as wrap from dies),
own as (select *, case tag when 'DW_TAG_base_type' then coalesce(name, 'UNKNOWN_BASE') when 'DW_TAG_typedef' then coalesce(name, 'typedef_anon') when 'DW_TAG_structure_type' then 'structure_type ' || coalesce(name, '/*anon*/') when 'DW_TAG_union_type' then 'union_type ' || coalesce(name, '/*anon*/') when 'DW_TAG_enumeration_type' then 'enumeration_type ' || coalesce(name, '/*anon*/') else coalesce(name, 'UNKNOWN_TYPE') end as plain,
  case tag when 'DW_TAG_const_type' then 'const ' when 'DW_TAG_volatile_type' then 'volatile ' else '' end as pre, case tag when 'DW_TAG_pointer_type' then ' *' else '' end as post from wr),
walk as (select o_path, die_off, die_off as at, '' as pre, '' as post, 0 as depth from own union all select w.o_path, w.die_off, o.type_off, w.pre || o.pre, o.post || w.post, w.depth + 1 from walk w join own o on o.o_path = w.o_path and o.die_off = w.at where o.wrap and o.type_off is not null and w.depth <= 10),
ended as (select w.o_path, w.die_off, case when w.depth > 10 then w.pre || 'UNKNOWN_TYPE' || w.post when not o.wrap then w.pre || o.plain || w.post else w.pre || o.pre || case when o.tag = 'DW_TAG_pointer_type' then 'void' else 'UNKNOWN_TYPE' end || o.post || w.post end as type_name from walk w join own o on o.o_path = w.o_path and o.die_off = w.at where w.depth > 10 or not o.wrap or o.type_off is null)"""


@query(f"{DIE_SQL} select o_path, die_off, type_name from ended")
def dwarf_type_names(spark, d):
    return debuginfo.type_names(A.dies(spark, d)).select("o_path", "die_off", "type_name")


SIGNED = f"""{DIE_SQL}, pa as (select d.o_path, parent_off, string_agg(coalesce(e.type_name, 'UNKNOWN_TYPE') || ' ' || coalesce(name, 'param'), ', ' order by ord) as ps from dies d left join ended e on e.o_path = d.o_path and e.die_off = d.type_off where tag = 'DW_TAG_formal_parameter' group by all),
si as (select d.o_path, ord, name as func_name, coalesce(e.type_name, 'void') || ' ' || name || '(' || coalesce(ps, 'void') || ');' as signature_hint from dies d left join ended e on e.o_path = d.o_path and e.die_off = d.type_off left join pa on pa.o_path = d.o_path and pa.parent_off = d.die_off where tag = 'DW_TAG_subprogram' and name is not null)"""


@query(f"{SIGNED} select o_path, ord, func_name, signature_hint from si")
def dwarf_signatures(spark, d):
    return debuginfo.signatures(A.dies(spark, d)).select("o_path", "ord", "func_name", "signature_hint")


@query(f"{SIGNED} select func_name, string_agg(o_path || ' ' || signature_hint, chr(10) order by o_path, ord) as hints from si group by func_name")
def dwarf_scan(spark, d):
    """All signatures of each name over all objects."""
    found = debuginfo.lookup(debuginfo.signatures(A.dies(spark, d)))
    return found.select("func_name", F.array_join(F.transform("hints", lambda x: F.concat_ws(" ", x["o_path"], x["signature_hint"])), "\n").alias("hints"))


@query(f"{SIGNED} select func_name, signature_hint from (select *, row_number() over (partition by func_name order by o_path, ord) as n from si) where n = 1")
def signature_lookup(spark, d):
    return debuginfo.first_signature(debuginfo.signatures(A.dies(spark, d)))


def _matches(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr("'f' || s_suppkey % 10 as func_name", "'/r/p' || s_suppkey % 10 || '/executable0' as binary_path", "'/r/p' || s_suppkey % 7 || case when s_suppkey % 2 = 0 then '/x' else '' end || '/o' || s_suppkey || '.o' as o_path", "cast(s_suppkey as int) as ord")


MATCH = "mt as (select 'f' || s_suppkey % 10 as func_name, s_suppkey % 10 = s_suppkey % 7 as near, s_suppkey % 2 = 0 as deep, s_suppkey::int as ord from supplier)"


@query(f"with {MATCH} select func_name, arg_min(ord, (case when near then 0 else 1000000 end) + ord) as ord from mt group by func_name")
def best_match_containment(spark, d):
    return debuginfo.best_by_containment(_matches(spark, d)).select("func_name", "ord")


@query(f"with {MATCH} select func_name, arg_min(ord, (case when near then 0 else 2 end + case when deep then 1 else 0 end) * 1000000 + ord) as ord from mt group by func_name")
def best_match_depth(spark, d):
    return debuginfo.best_by_depth(_matches(spark, d)).select("func_name", "ord")


@query(f"""{PROMPT} select 'b/executable0' as binary_path, name as target_function_name, model_input, case when target % 2 = 0 then 'int f_' || target || '(int x);' else '{fixed.NO_LABEL}' end as label_c_code, 'train' as context_role from pr""")
def samples(spark, d):
    targets, context, block = _prompt_parts(spark, d)
    made = prompts.prompts(targets, context, block)
    sig = F.when(F.col("target") % 2 == 0, F.concat(F.lit("int f_"), F.col("target").cast("string"), F.lit("(int x);")))
    truth = targets.select("binary_id", "target", labels.final_label(F.lit(None).cast("string"), sig).alias("label_c_code"))
    return prompts.samples(targets.withColumn("binary_path", F.lit("b/executable0")), made, truth, "train")


@query("select event_id, case when event_type = 'click' then 'train' else 'inference' end as context_role from events")
def mode_role(spark, d):
    mode = F.when(F.col("event_type") == "click", "train").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", C.context_role(mode).alias("context_role"))
