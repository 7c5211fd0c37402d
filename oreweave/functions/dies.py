"""Type names and signatures of all entries of some objects, in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans import fixed

WRAPS = {"DW_TAG_pointer_type": ("", " *"), "DW_TAG_const_type": ("const ", ""), "DW_TAG_volatile_type": ("volatile ", ""), "DW_TAG_restrict_type": ("", "")}
NAMED = ("DW_TAG_structure_type", "DW_TAG_union_type", "DW_TAG_enumeration_type")
UNKNOWN = pa.scalar("UNKNOWN_TYPE")


def _keys(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    """Numbers that are equal where object and offset are; -1 without an offset."""
    path = rows["o_path"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = [rows[c].combine_chunks() for c in columns]
    values, number = np.unique(np.concatenate([o.fill_null(0).to_numpy() for o in offsets]), return_inverse=True)
    parts = np.split(number, len(columns))
    return [np.where(o.is_valid().to_numpy(zero_copy_only=False), path * len(values) + n, -1) for o, n in zip(offsets, parts, strict=True)]


def _at(keys: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Place of each wanted key; null where there is none."""
    by = np.argsort(keys, kind="stable")
    place = by[np.minimum(np.searchsorted(keys, wanted, sorter=by), len(keys) - 1)]
    return pa.array(place, mask=(keys[place] != wanted) | (wanted < 0))


def _own(rows: pa.Table) -> pa.Array:
    """Names of entries that wrap no other."""
    tag, name = rows["tag"].combine_chunks(), rows["name"].combine_chunks()
    named = pc.binary_join_element_wise(pc.replace_substring(tag, "DW_TAG_", ""), pc.fill_null(name, "/*anon*/"), " ")
    is_a = lambda t: pc.fill_null(pc.equal(tag, t), False)
    out = pc.if_else(is_a("DW_TAG_base_type"), pc.fill_null(name, "UNKNOWN_BASE"), pc.fill_null(name, "UNKNOWN_TYPE"))
    out = pc.if_else(is_a("DW_TAG_typedef"), pc.fill_null(name, "typedef_anon"), out)
    return pc.if_else(pc.is_in(tag, pa.array(NAMED)), named, out)


def type_names(rows: pa.Table, die: np.ndarray, kind: np.ndarray, depth: int) -> pa.Array:
    """After round d each entry has the name it has as seen with d steps left; a reference one step too deep is unknown."""
    tag = rows["tag"].combine_chunks()
    index = pc.index_in(tag, pa.array(list(WRAPS)))
    wraps = index.is_valid().to_numpy(zero_copy_only=False)
    chain = np.flatnonzero(wraps)
    plain = _own(rows)
    if not len(chain):
        return plain
    pre, post = (pa.array([w[i] for w in WRAPS.values()]).take(index.take(pa.array(chain))) for i in range(2))
    bare = pa.array(kind[chain] < 0)
    last = pc.if_else(pc.equal(post, " *"), "void", UNKNOWN)
    to = _at(die, kind[chain])
    # names stand behind each other: those of all entries, then those of the chain as they are now
    turn = np.zeros(len(wraps), np.int64)
    turn[chain] = np.arange(len(chain))
    to_chain, to_plain = (pc.take(pa.array(x), to) for x in (np.where(wraps, turn, 0), np.arange(len(wraps))))
    leads = pc.fill_null(pc.take(pa.array(wraps), to), False)
    fixed_inner = pc.fill_null(pc.take(plain, to_plain), UNKNOWN)
    named = lambda inner: pc.binary_join_element_wise(pre, pc.if_else(bare, last, inner), post, "")
    now = named(pa.repeat(UNKNOWN, len(chain)))
    for _ in range(depth):
        new = named(pc.if_else(leads, pc.take(now, to_chain), fixed_inner))
        if new.equals(now):
            break
        now = new
    place = np.arange(len(wraps))
    place[chain] = len(wraps) + np.arange(len(chain))
    return pa.concat_arrays([plain, now]).take(pa.array(place))


def names(rows: pa.Table, depth: int = fixed.MAX_TYPE_DEPTH) -> pa.Table:
    die, kind = _keys(rows, "die_off", "type_off")
    return pa.table({"o_path": rows["o_path"], "die_off": rows["die_off"], "type_name": type_names(rows, die, kind, depth)})


def signatures(rows: pa.Table, depth: int = fixed.MAX_TYPE_DEPTH) -> pa.Table:
    """Functions with a name right under a unit, with their parameters in order."""
    die, kind, parent = _keys(rows, "die_off", "type_off", "parent_off")
    typed = pc.take(type_names(rows, die, kind, depth), _at(die, kind))
    typed = pc.if_else(pa.array(kind < 0), pa.scalar(None, pa.string()), pc.fill_null(typed, UNKNOWN))
    tag, name = rows["tag"].combine_chunks(), rows["name"].combine_chunks()
    is_a = lambda t: pc.fill_null(pc.equal(tag, t), False).to_numpy(zero_copy_only=False)
    param = np.flatnonzero(is_a("DW_TAG_formal_parameter") & (parent >= 0))
    text = pc.binary_join_element_wise(pc.fill_null(typed.take(pa.array(param)), UNKNOWN), pc.fill_null(name.take(pa.array(param)), "param"), " ")
    order = rows["ord"].combine_chunks().fill_null(-(2**31)).to_numpy()
    by = np.lexsort((pc.rank(text, tiebreaker="dense").to_numpy() if len(param) else param, order[param], parent[param]))
    of, begin = np.unique(parent[param][by], return_index=True)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(param)), pa.int32()), text.take(pa.array(by))), ", ")
    func = np.flatnonzero(is_a("DW_TAG_subprogram") & name.is_valid().to_numpy(zero_copy_only=False) & np.isin(parent, die[is_a("DW_TAG_compile_unit")]) & (parent >= 0))
    params = pc.fill_null(pc.take(joined, _at(of, die[func])), "void") if len(of) else pa.repeat(pa.scalar("void"), len(func))
    at = pa.array(func)
    hint = pc.binary_join_element_wise(pc.fill_null(typed.take(at), "void"), " ", name.take(at), "(", params, ");", "")
    return pa.table({"o_path": rows["o_path"].take(at), "ord": rows["ord"].take(at), "func_name": name.take(at), "signature_hint": hint})
