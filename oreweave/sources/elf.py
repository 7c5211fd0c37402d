"""Functions, symbols and loaded bytes of ELF files, read from their tables without any tool."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import tools

# Fixed values of the file format.
SYMTAB, DYNSYM, NOBITS = 2, 11, 8
LOAD = 1
FUNC, NOTYPE = 2, 0


@dataclass
class Section:
    name: str
    kind: int
    addr: int
    offset: int
    size: int
    link: int
    entry: int


class Elf:
    """An ELF file of either width and byte order; raises ``ValueError`` for anything else."""

    def __init__(self, data: bytes):
        if data[:4] != b"\x7fELF" or len(data) < 52:
            raise ValueError("no ELF file")
        self.data, self.wide = data, data[4] == 2
        self.order = "<" if data[5] == 1 else ">"
        head = self._read("HHIQQQIHHHHHH" if self.wide else "HHIIIIIHHHHHH", 16)
        ph_at, sh_at, (ph_size, ph_n, sh_size, sh_n, names) = head[4], head[5], head[8:]
        rows = [self._read("IIQQQQIIQQ" if self.wide else "IIIIIIIIII", sh_at + i * sh_size) for i in range(sh_n)]
        self.sections = [Section("", r[1], r[3], r[4], r[5], r[6], r[9]) for r in rows]
        if names < sh_n:
            for s, r in zip(self.sections, rows, strict=True):
                s.name = self._text(self.sections[names], r[0])
        self.programs = [self._read("IIQQQQQQ" if self.wide else "IIIIIIII", ph_at + i * ph_size) for i in range(ph_n)]

    def _read(self, form: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + form, self.data, at)
        except struct.error as e:
            raise ValueError("cut short") from e

    def _text(self, table: Section, at: int) -> str:
        begin = table.offset + at
        return self.data[begin : self.data.index(b"\0", begin)].decode("utf-8", "replace")

    def symbols(self) -> list[dict]:
        """``name, addr, size, kind, section`` (0: undefined) of both symbol tables, in order, each once."""
        out, seen = [], set()
        for table in self.sections:
            if table.kind not in (SYMTAB, DYNSYM) or not table.entry:
                continue
            for i in range(1, table.size // table.entry):
                at = table.offset + i * table.entry
                if self.wide:
                    name, info, _, section, addr, size = self._read("IBBHQQ", at)
                else:
                    name, addr, size, info, _, section = self._read("IIIBBH", at)
                row = {"name": self._text(self.sections[table.link], name), "addr": addr, "size": size, "kind": info & 15, "section": section}
                if tuple(row.values()) not in seen:
                    seen.add(tuple(row.values()))
                    out.append(row)
        return out

    def functions(self) -> list[dict]:
        """``addr, name, size, is_plt`` of the functions defined, one for each address; the first name counts."""
        stubs = [(s.addr, s.addr + s.size) for s in self.sections if s.name.startswith(".plt")]
        found: dict[int, dict] = {}
        for s in self.symbols():
            code = s["kind"] == FUNC or (s["kind"] == NOTYPE and s["section"] < len(self.sections) and self.sections[s["section"]].name == ".text")
            if code and s["section"] and s["name"]:
                found.setdefault(s["addr"], {"addr": s["addr"], "name": s["name"], "size": s["size"], "is_plt": any(a <= s["addr"] < b for a, b in stubs)})
        return [found[a] for a in sorted(found)]

    def segments(self) -> list[dict]:
        """``vaddr, bytes`` of what is loaded; of a file without segments, of its sections that have an address."""
        if self.programs:
            parts = [(p[3], p[2], p[5]) if self.wide else (p[2], p[1], p[4]) for p in self.programs if p[0] == LOAD]
        else:
            parts = [(s.addr, s.offset, s.size) for s in self.sections if s.addr and s.kind != NOBITS]
        return [{"vaddr": addr, "bytes": self.data[at : at + size]} for addr, at, size in parts if size]


def functions(binaries: DataFrame) -> DataFrame:
    """``path, content`` to ``binary_id, status, addr, name, size, is_plt``; what is no ELF file gives a row with its status."""
    return tools.extract(binaries, lambda data: Elf(data).functions(), "binary_id string, status string, addr long, name string, size long, is_plt boolean")


def segments(binaries: DataFrame) -> DataFrame:
    """``path, content`` to ``binary_id, status, vaddr, bytes``."""
    return tools.extract(binaries, lambda data: Elf(data).segments(), "binary_id string, status string, vaddr long, bytes binary")


def undefined(binaries: DataFrame) -> DataFrame:
    """``path, content`` to ``binary_id, status, symbol``: named symbols that other files must define."""
    return tools.extract(binaries, lambda data: [{"symbol": s["name"]} for s in Elf(data).symbols() if s["name"] and not s["section"]], "binary_id string, status string, symbol string")
