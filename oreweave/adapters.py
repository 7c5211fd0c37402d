"""The driver's tables in the shapes that operators take, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FN = {
    "addr": "p_partkey",
    "name": "case when p_partkey = 1 then 'main' when p_partkey % 37 = 0 then 'printf' when p_partkey % 41 = 0 then '__' || replace(p_name, ' ', '_') when p_partkey % 43 = 0 then '_start' when p_partkey % 47 = 0 then '' else replace(p_name, ' ', '_') || '_' || p_partkey end",
    "is_plt": "p_size % 13 = 0",
    "n_blocks": "cast(1 + p_size % 6 as int)",
    "n_insns": "cast(p_size as int)",
    "cfg_nodes": "cast(1 + p_size % 6 as int)",
    "cfg_edges": "cast(p_size % 9 as int)",
    "token_count": "cast(p_size * 20 as bigint)",
}
EDGE_STEP = "lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
SYM_NAME = "case when l_partkey % 5 = 0 then 'lib_' else 'sym_' end || cast(l_partkey % 400 as string)"
O_PATH = "'COMPILED/' || cast({repo} as string) || '/' || cast({obj} as string) || '.o'"

FN_SQL = "fn as (select " + ", ".join(f"{e} as {n}" for n, e in FN.items()) + " from part)"
EDGE_SQL = f"ed as (select distinct a as src, b as dst from (select l_partkey as a, {EDGE_STEP} as b from lineitem) where b is not null)"
SYM_SQL = f"""sy as (
  select distinct cast(o_custkey % 150 as string) as repo, {O_PATH.format(repo="o_custkey % 150", obj="l_orderkey")} as obj, case l_linestatus when 'F' then 'T' else 'U' end as st, {SYM_NAME} as s from lineitem join orders on l_orderkey = o_orderkey
  union select cast(o_custkey % 150 as string), {O_PATH.format(repo="o_custkey % 150", obj="o_orderkey")}, 'T', 'main' from orders where o_orderkey % 10 = 0)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr("'b' as binary_id", *[f"{e} as {n}" for n, e in FN.items()])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines of one number and part are the same step, so the rest of EDGE_STEP's order changes no edge and need not be shuffled
    step = _read(spark, sf_dir, "lineitem").selectExpr("l_partkey as src", "lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst")
    return step.filter("dst is not null").selectExpr("'b' as binary_id", "src", "dst")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions stand for the order in which a symbol lister prints: by name."""
    orders = _read(spark, sf_dir, "orders")
    repo = "cast(o_custkey % 150 as string) as repo"
    used = _read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(repo, O_PATH.format(repo="o_custkey % 150", obj="l_orderkey") + " as o_path", "case l_linestatus when 'F' then 'T' else 'U' end as sym_type", f"{SYM_NAME} as name")
    main = orders.filter("o_orderkey % 10 = 0").selectExpr(repo, O_PATH.format(repo="o_custkey % 150", obj="o_orderkey") + " as o_path", "'T' as sym_type", "'main' as name")
    # dealt by object once, for the different rows and for their order
    return used.unionByName(main).repartition("repo", "o_path").distinct().selectExpr("repo", "o_path", "cast(rank() over (partition by repo, o_path order by name) as int) as pos", "sym_type", "name")


REPO_SQL = "rf as (select source || '/' || lang as repo_name, 'd/' || cast(doc_id % 400 as string) || '.c' as file_path, text as file_content, doc_id from documents)"


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump row for each repository: files in the order of their ids."""
    d = _read(spark, sf_dir, "documents").selectExpr("source || '/' || lang as repo_name", "doc_id", "'d/' || cast(doc_id % 400 as string) || '.c' as file_path", "text as file_content")
    return d.withColumn("src_file", F.lit("documents")).withColumn("block", F.lit(0)).withColumnRenamed("doc_id", "seq").select("src_file", "block", "seq", "repo_name", F.array(F.struct("file_path", "file_content")).alias("files"))


SRC_SQL = r"src as (select page_id, url, regexp_replace(html, '<(/?[a-z]+)', '#include <\1', 'g') as content from pages)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<(/?[a-z]+)", "#include <$1").alias("content"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without instructions of their own, as text."""
    return _read(spark, sf_dir, "conversations").selectExpr("'b' as binary_id", "conv_id as func_addr", "cast(turn as int) as block_ord", "turn * 16 + 4096 as block_addr", "cast(null as array<struct<text: string>>) as insns", "text as own")


LIT_SQL = """lit as (
  select 4198400 + page_id * 1000 + i as addr, t as text from (select page_id, unnest(range(1, len(x) + 1)) as i, trim(unnest(x)) as t from (select page_id, regexp_extract_all(html, '>([^<]+)<', 1) as x from pages)) where t <> ''
  union all select 900000000 + p_partkey, case p_partkey % 3 when 0 then '%' || p_size || 'd ' || p_name when 1 then p_name else p_name || ';' end from part)"""


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(">([^<]+)<"), F.lit(1))).alias("i", "t"))
    found = found.select((F.lit(4198400) + F.col("page_id") * 1000 + F.col("i") + 1).alias("addr"), F.trim("t").alias("text")).filter("text <> ''")
    made = _read(spark, sf_dir, "part").selectExpr("900000000 + p_partkey as addr", "case p_partkey % 3 when 0 then '%' || p_size || 'd ' || p_name when 1 then p_name else p_name || ';' end as text")
    return found.unionByName(made)


CSRC = "'int f_' || p_partkey || '(int x) {\n  puts(\"' || p_name || '\");\n  return x;\n}\n'"
CSRC_SQL = f"cs as (select p_partkey as addr, 'f_' || p_partkey as name, {CSRC} as content, p_name as lit from part)"


def c_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr("p_partkey as addr", "'f_' || p_partkey as name", f"{CSRC} as content", "p_name as lit")


#: Twelve symbols, by event.
UNDEF_NAMES = ["printf", "malloc", "socket", "strlen", "close", "pthread_create", "fopen", "htons", "sqrt", "unknown_fn", "__stack_chk_fail", "time"]
UNDEF_SYM = "case event_id % 12 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(UNDEF_NAMES)) + " end"
UNDEF_SQL = f"un as (select cast(user_id as string) as binary_id, {UNDEF_SYM} as sym from events)"


def readelf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"'  ' || event_id || ': 0000000000000000 0 FUNC GLOBAL DEFAULT  UND ' || {UNDEF_SYM} || '@GLIBC_2.2.5'"
    return _read(spark, sf_dir, "events").selectExpr("cast(user_id as string) as binary_id", "cast(event_id as int) as line_no", f"{line} as line")


#: Entries of an object's debug information: offset, parent, order, tag, name and type; {k} stands for a number of the object's part, {deep} for
#: how many links its chain of pointers has.
_DIES = [
    (0, None, 0, "DW_TAG_compile_unit", None, None), (1, 0, 1, "DW_TAG_base_type", "int", None), (2, 0, 2, "DW_TAG_base_type", "char", None), (3, 0, 3, "DW_TAG_pointer_type", None, 2),
    (4, 0, 4, "DW_TAG_const_type", None, 2), (5, 0, 5, "DW_TAG_pointer_type", None, 4), (6, 0, 6, "DW_TAG_const_type", None, 3), (7, 0, 7, "DW_TAG_pointer_type", None, None),
    (8, 0, 8, "DW_TAG_structure_type", None, None), (9, 0, 9, "DW_TAG_structure_type", "node_{k}", None), (10, 0, 10, "DW_TAG_typedef", "size_{k}", 1), (11, 0, 11, "DW_TAG_volatile_type", None, 1),
    (12, 0, 12, "DW_TAG_subprogram", "check_{k}", 1), (13, 12, 13, "DW_TAG_formal_parameter", "ptr", 5), (14, 12, 14, "DW_TAG_formal_parameter", None, 10), (15, 12, 15, "DW_TAG_formal_parameter", "raw", None),
    (16, 0, 16, "DW_TAG_subprogram", "nothing", None), (17, 0, 17, "DW_TAG_subprogram", None, 1), (18, 0, 18, "DW_TAG_restrict_type", None, 7), (19, 0, 19, "DW_TAG_enumeration_type", "colour", None),
    *[(20 + i, 0, 20 + i, "DW_TAG_pointer_type", None, f"case when {i} < {{deep}} then {21 + i} else 9 end" if i < 12 else 1) for i in range(13)],
    (40, 0, 40, "DW_TAG_subprogram", "walk_{k}", 20), (41, 40, 41, "DW_TAG_formal_parameter", "from", 9), (42, 40, 42, "DW_TAG_formal_parameter", "to", 6),
]


def _die_fields(row: tuple) -> list[str]:
    """One entry's fields as SQL over ``part``."""
    off, parent, order, tag, name, kind = row
    text = "cast(null as string)" if name is None else "'" + name.replace("{k}", "' || (p_partkey % 50) || '") + "'"
    number = lambda x: f"cast({'null' if x is None else str(x).replace('{deep}', '(p_size % 14)')} as bigint)"
    return [number(off), number(parent), str(order), f"'{tag}'", text, number(kind)]


_DIE_COLS = ["die_off", "parent_off", "ord", "tag", "name", "type_off"]
O_OF_PART = "'COMPILED/p' || p_partkey || '.o'"
DIE_SQL = "dies as (" + " union all ".join(f"select {O_OF_PART} as o_path, " + ", ".join(f"{e} as {n}" for n, e in zip(_DIE_COLS, _die_fields(row), strict=True)) + " from part" for row in _DIES) + ")"


def dies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each part, with an entry for each of ``_DIES``."""
    rows = ", ".join("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in zip(_DIE_COLS, _die_fields(row), strict=True)) + ")" for row in _DIES)
    made = _read(spark, sf_dir, "part").selectExpr(f"{O_OF_PART} as o_path", f"inline(array({rows}))")
    return made.withColumn("ord", F.col("ord").cast("int"))


#: What the dump of a file of each document holds; every seventh line is no JSON.
BROKEN = "doc_id % 7 = 3"


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: lines of a dump, one for each document."""
    d = _read(spark, sf_dir, "documents").filter("text is not null")
    files = F.array(F.struct(F.concat(F.lit("./d//"), F.col("doc_id"), F.lit(".c")).alias("file_path"), F.col("text").alias("file_content")))
    made = d.withColumn("line", F.to_json(F.struct(F.concat_ws("/", "source", "lang").alias("repo_name"), files.alias("file_array"))))
    return made.select(F.when(F.expr(BROKEN), F.concat("line", F.lit(" x"))).otherwise(F.col("line")).alias("value"))


def nm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, o_path, pos, line`` as a symbol lister prints them, with a line that names no symbol."""
    said = F.when(F.col("sym_type") == "U", F.concat(F.lit("                 U "), "name")).otherwise(F.concat(F.lpad(F.lower(F.hex("pos")), 16, "0"), F.lit(" T "), "name"))
    return symbols(spark, sf_dir).select("repo", "o_path", "pos", said.alias("line"))


def insn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks for each part's function, given last first; the second of every fifth could not be lifted."""
    insn = lambda text: f"named_struct('address', cast(0 as bigint), 'size', 4, 'text', {text}, 'operands', array(named_struct('type', 'REG', 'imm', cast(null as bigint), 'base', cast(null as string), 'disp', cast(null as bigint))))"
    of = lambda *texts: f"array({', '.join(insn(t) for t in texts)})"
    first, second, third = of("'push rbp'", "'mov eax, ' || p_size"), of("'call ' || p_partkey"), of("'ret'")
    row = lambda n, insns: f"named_struct('block_ord', {n}, 'block_addr', cast({4096 + 16 * n} as bigint), 'insns', {insns})"
    return _read(spark, sf_dir, "part").selectExpr("'b' as binary_id", "p_partkey as func_addr", f"inline(array({row(2, third)}, {row(1, f'case when p_partkey % 5 <> 0 then {second} end')}, {row(0, first)}))")
