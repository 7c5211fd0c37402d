"""Scalar functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import fixed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row: a lambda variable is bound once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def quote_includes(code: Column) -> Column:
    """``#include <x>`` to ``#include "x"``; only a line feed ends a name, and any Unicode space may precede it."""
    return F.regexp_replace(code, r"(?Ud)#include\s*<(.*?)>", '#include "$1"')


def repo_key(name: Column) -> Column:
    """Slashes to underscores; different names may meet in one key."""
    return F.translate(name, "/", "_")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def mirrored(path: Column, root: Column, new_root: Column, suffix: str) -> Column:
    """A path below ``root`` put below ``new_root`` with its last suffix replaced, or appended where it has none."""
    parts, skip = path_parts(path), F.size(path_parts(root))
    tail = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))
    rest = let(tail, lambda t: F.concat(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.array(F.concat(F.regexp_replace(F.element_at(t, -1), r"\.[^.]*\z", ""), F.lit(suffix)))))
    return F.concat_ws("/", F.regexp_replace(new_root, r"/+\z", ""), F.array_join(rest, "/"))


def parent_dirs(path: Column) -> Column:
    """Every directory above a file's path except the top one; the top one alone gives an empty array."""
    parts = path_parts(path)
    return let(parts, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))).otherwise(F.array().cast("array<string>")))


def include_flags(dirs: Column) -> Column:
    return F.array_join(F.transform(dirs, lambda d: F.concat(F.lit('-I"'), d, F.lit('"'))), " ")


def compile_options(c_path: Column, o_path: Column, flags: Column, compiler: str = fixed.COMPILER, level: int = fixed.OPTIMISATION) -> Column:
    return F.concat(F.lit(f'{compiler} -c -gdwarf -O{level} -o "'), o_path, F.lit('" "'), c_path, F.lit('" '), flags)


def compile_command(options: Column, blocks: int = fixed.FILE_BLOCKS, timeout: int = fixed.TIMEOUT_S) -> Column:
    return F.concat(F.lit(f"ulimit -f {blocks} && timeout {timeout} "), options)


def fits_shell(command: Column, most: int = fixed.ARG_MAX) -> Column:
    return F.length(command) <= most


def link_command(repo_dir: Column, index: Column, main: Column, objects: Column) -> Column:
    return F.concat(F.lit("gcc -o "), repo_dir, F.lit("/executable"), index.cast("string"), F.lit(" "), main, F.lit(" "), F.array_join(objects, " "))


def with_provenance(code: Column, options: Column, ok: Column) -> Column:
    return F.when(ok, F.concat(F.lit("//"), options, F.lit("\n"), code)).otherwise(code)


def with_program_tags(code: Column, indices: Column) -> Column:
    """Name each program at the end of a source; a name that is part of the last line already counts as there."""
    # in order of number no name is part of one ahead of it, so all are looked up in the line as it is
    names = F.array_distinct(F.transform(F.array_sort(indices), lambda i: F.concat(F.lit("executable"), i.cast("string"))))
    last = F.regexp_extract(code, r"([^\n]*\n?)\z", 1)
    more = F.filter(names, lambda name: ~last.contains(name))
    longer = F.concat(F.left(code, F.length(code) - F.length(last)), strip(last), F.lit(", "), F.array_join(more, ", "))
    fresh = F.concat(code, F.lit("\n//"), F.array_join(names, ", "))
    return F.when(F.size(names) == 0, code).when(~last.startswith("//executable"), fresh).otherwise(F.when(F.size(more) == 0, code).otherwise(longer))


def symbol_base(symbol: Column) -> Column:
    """Without its version."""
    return F.when(symbol.contains("@@"), F.substring_index(symbol, "@@", 1)).otherwise(F.substring_index(symbol, "@", 1))


def c_size_estimate(nodes: Column, edges: Column) -> Column:
    """Tokens of C text from the flow graph; no function: infinite, no graph: 1."""
    return F.when(nodes.isNull(), F.lit(float("inf"))).when(nodes == 0, F.lit(1.0)).otherwise((edges * 1.5 + nodes * 1.0) * 5.0)


def is_tiny(n_blocks: Column, n_insns: Column) -> Column:
    return (n_blocks <= fixed.TINY_BLOCKS) & (n_insns <= fixed.TINY_INSNS)


def is_user_like(name: Column, is_plt: Column, tiny: Column, is_target: Column) -> Column:
    """Whether a function is the project's own rather than the runtime's, a stub or a trampoline."""
    named = name.isNotNull() & (name != "")
    foreign = name.isin(fixed.RUNTIME_ENTRY_FUNCTIONS) | is_plt | name.startswith("__") | tiny
    return F.coalesce(named & (is_target | (name == "main") | ~foreign), F.lit(False))


def is_printable(data: Column) -> Column:
    """At least 70 % of the bytes are printable ASCII, TAB, LF or CR; nothing is not."""
    good = F.length(F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x09\x0a\x0d\x20-\x7e]", ""))
    return F.coalesce((F.octet_length(data) > 0) & (good / F.octet_length(data) >= 0.7), F.lit(False))


def literal_kind(text: Column) -> Column:
    low = F.lower(text)
    command = reduce(lambda a, b: a | b, [low.contains(w) for w in fixed.COMMAND_WORDS])
    return F.when(command, "CMD").when(text.rlike(fixed.FORMAT_PATTERN), "FMT").otherwise("STR")


def blob_kind(data: Column, text: Column) -> Column:
    return F.when(is_printable(data), literal_kind(text)).otherwise("DAT")


def placeholder(kind: Column, addr: Column) -> Column:
    return F.concat(kind, F.lit("x"), F.lower(F.hex(addr)))


def constant_address(insn: Column) -> Column:
    """The first operand of an instruction that names a constant's address: a large immediate, or memory relative to the
    instruction pointer or to nothing."""
    address = lambda o: F.when(o["type"] == "IMM", o["imm"]).when((o["type"] == "MEM") & (F.lower(o["base"]) == "rip"), insn["address"] + insn["size"] + o["disp"]).when((o["type"] == "MEM") & (F.coalesce(o["base"], F.lit("")) == ""), o["disp"])
    return F.get(F.filter(F.transform(insn["operands"], address), lambda a: a > fixed.LOWEST_CONSTANT), 0)


def context_role(mode: Column) -> Column:
    return F.when(mode == "train", "train").otherwise("inference")


def listing(blocks: Column) -> Column:
    """Text of a function from ``array<struct<ord, addr, lines array<string>, own string>>``; a block that could not be lifted has
    null lines and no own text and is left out."""
    lifted = F.filter(F.array_sort(blocks), lambda b: b["lines"].isNotNull() | b["own"].isNotNull())
    one = lambda b: F.concat(F.array(F.concat(F.lit(";;; Block @ 0x"), F.lower(F.hex(b["addr"])))), F.when(F.coalesce(F.size(b["lines"]), F.lit(0)) > 0, b["lines"]).otherwise(F.array(b["own"])))
    return F.array_join(F.flatten(F.transform(lifted, one)), "\n")
