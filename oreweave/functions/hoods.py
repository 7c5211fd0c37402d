"""What lies around the targets of one block of a call graph, in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..plans import fixed

#: Cells of a batch of targets by nodes.
CELLS = 1 << 21
#: Nodes found by a block of targets of a graph without locality, with repeats.
FOUND = 20_000_000
#: Bytes of a piece of a packed page: Arrow takes 10,000 pieces at once.
PIECE = 1600


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    lists = column.combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _expand(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all successors of ``nodes``, and which of the nodes each belongs to."""
    sizes = first[nodes + 1] - first[nodes]
    of = np.repeat(np.arange(len(nodes)), sizes)
    return np.arange(len(of)) + (first[nodes] - np.cumsum(sizes) + sizes)[of], of


class Near:
    """Nodes with the lists of all that a search of ``degrees`` steps passes, its targets, and facts of functions; nodes are numbered here."""

    def __init__(self, rows: pa.Table, degrees: int, corrected: bool) -> None:
        kind = rows["kind"].to_numpy()
        lists, facts = rows.filter(pa.array(kind < 2)), rows.filter(pa.array(kind == 2))
        n, kind = lists["n"].to_numpy(), kind[kind < 2]
        (n_out, outs), (n_in, ins) = _flat(lists["outs"]), _flat(lists["ins"])
        self.addr = np.unique(np.concatenate((n, outs, ins)).astype(np.int64))
        self.degrees, self.size, at = degrees, len(self.addr), np.searchsorted(self.addr, n)
        self.targets = np.sort(at[kind == 1])
        csr = [self._csr(at, n_out, outs), self._csr(at, n_in, ins)]
        self.steps, self.into = (csr[::-1], 0) if corrected else (csr, 1)
        # facts of the nodes here; row -1 where a function is not known
        fact_at = np.searchsorted(self.addr, facts["n"].to_numpy())
        here = np.flatnonzero(self.addr[np.minimum(fact_at, self.size - 1)] == facts["n"].to_numpy()) if self.size else np.zeros(0, int)
        here = here[np.argsort(fact_at[here], kind="stable")]
        self.facts = facts.take(pa.array(here))
        self.fact = np.full(self.size, -1)
        self.fact[fact_at[here]] = np.arange(len(here))

    def _csr(self, at: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        per = np.zeros(self.size, np.int64)
        per[at] = sizes
        first = np.concatenate(([0], np.cumsum(per)))
        to = np.empty(len(values), np.int64)
        begin = np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes)
        to[begin + np.arange(len(values))] = np.searchsorted(self.addr, values)
        return first, to

    def address(self, nodes: np.ndarray) -> np.ndarray:
        return self.addr[nodes]

    def fact_of(self, nodes: np.ndarray) -> np.ndarray:
        return self.fact[nodes]

    def around(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For batches of targets: the targets, and for each that is found the number of its target, its node and its smallest degree by
        either role, 0 without any; by target and node.

        Nodes of one round count as visited in ascending order: a neighbour in the same round is taken from a smaller node only,
        or through a self-loop.
        """
        batch = max(1, CELLS // max(1, self.size))
        for begin in range(0, len(self.targets), batch):
            ts = self.targets[begin : begin + batch]
            cells = len(ts) * self.size
            since, degree = np.zeros(cells, np.uint8), [np.zeros(cells, np.uint8) for _ in self.steps]
            since[np.arange(len(ts)) * self.size + ts] = 255
            row, node = np.arange(len(ts)), ts
            for d in range(1, self.degrees + 1):
                seen, up = ([np.zeros(cells, bool) for _ in self.steps] for _ in range(2))
                for r, (first, to) in enumerate(self.steps):
                    place, of = _expand(first, node)
                    f = to[place]
                    cell = row[of] * self.size + f
                    seen[r][cell] = True
                    if d > 1:
                        up[r][cell[node[of] <= f]] = True
                hit = np.flatnonzero(seen[0] | seen[1])
                was = since[hit]
                for r in range(len(self.steps)):
                    taken = np.where(was == 0, seen[r][hit], up[r][hit] & (was == d - 1)) & (degree[r][hit] == 0)
                    degree[r][hit[taken]] = d
                new = hit[was == 0]
                since[new] = d
                row, node = np.divmod(new, self.size)
            found = np.flatnonzero((since > 0) & (since < 255))
            row, node = np.divmod(found, self.size)
            yield ts, row, node, [x[found] for x in degree]


class Far:
    """The same for a graph without locality, whose lists pass by page by page, once a step, and are not held. Nodes are addresses less ``base``.

    ``parts`` has ``step, pages, lo, hi, base, bits``: ``step`` -1 brings facts, 0 the lists of the targets, which lie from ``lo`` to ``hi``, and d all lists, from which
    nodes of degree d are left. What is found is held as whole numbers: target, node, role, and whether from a smaller node.
    """

    def __init__(self, parts: Iterator[pa.RecordBatch], degrees: int, corrected: bool) -> None:
        self.degrees, self.into, self.order = degrees, 0 if corrected else 1, (1, 0) if corrected else (0, 1)
        self.parts, self.binary, facts, self.first = self._pages(parts), None, [], None
        for step, page in self.parts:
            if step >= 0:
                self.first = step, page
                break
            facts.append(page)
        facts = pa.concat_tables(facts) if facts else pa.table({"n": pa.array([], pa.int64())})
        n = facts["n"].to_numpy()
        by = np.argsort(n, kind="stable")
        self.facts, self.known = facts.take(pa.array(by)), n[by]
        self.table = None
        if self.first is not None and len(n) and self.bits <= 24:
            self.table = np.full(1 << self.bits, -1, np.int32)
            here = (self.known >= self.base) & (self.known < self.base + (1 << self.bits))
            self.table[self.known[here] - self.base] = np.flatnonzero(here)

    def _pages(self, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        last, begun = (-1, None, 0), []
        for b in parts:
            if self.binary is None and b.num_rows:
                self.binary, self.lo, self.hi, self.base, self.bits = (b.column(c)[0].as_py() for c in ("binary_id", "lo", "hi", "base", "bits"))
            for step, page, more, piece in zip(b.column("step").to_pylist(), b.column("page").to_pylist(), b.column("more").to_pylist(), b.column("packed"), strict=True):
                if step < last[0] or (last[2] and (step, page, more) != (*last[:2], last[2] - 1)):
                    raise RuntimeError("pages of a step came after those of the next, or a page in parts")
                last = step, page, more
                begun.append(piece.as_buffer())
                if not more:
                    yield step, pa.ipc.open_stream(b"".join(begun)).read_all()
                    begun = []
        if begun:
            raise RuntimeError("a page came in parts")

    def address(self, nodes: np.ndarray) -> np.ndarray:
        return nodes + self.base

    def fact_of(self, nodes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[nodes]
        if not len(self.known):
            return np.full(len(nodes), -1)
        at = np.minimum(np.searchsorted(self.known, nodes + self.base), len(self.known) - 1)
        return np.where(self.known[at] == nodes + self.base, at, -1)

    def _keep(self, keys: np.ndarray) -> None:
        if self.held + len(keys) > len(self.keys):
            now = self.keys[: self.held]
            now.sort()
            now = now[np.concatenate((now[:1] == now[:1], now[1:] != now[:-1]))]
            if len(now) + len(keys) > len(self.keys) // 2:
                self.keys = np.empty(2 * len(now) + 2 * len(keys), np.int64)
            self.keys[: len(now)], self.held = now, len(now)
        self.keys[self.held : self.held + len(keys)] = keys
        self.held += len(keys)

    def _step(self, page: pa.Table, row: np.ndarray, node: np.ndarray) -> None:
        """What is next to ``node`` (in order) of a page."""
        n = page["n"].to_numpy() - self.base
        begin, end = np.searchsorted(node, n[0]), np.searchsorted(node, n[-1], "right")
        row, node = row[begin:end], node[begin:end]
        at = np.searchsorted(n, node)
        for r, c in enumerate(self.order):
            sizes, to = _flat(page[("outs", "ins")[c]])
            place, of = _expand(np.concatenate(([0], np.cumsum(sizes))), at)
            f = to[place].astype(np.int64)
            self._keep(((row[of] << self.bits | f) << 2) + (node[of] <= f) + 2 * r)

    def _merged(self, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Cells of a batch of targets with what is known of them after ``d`` steps, in order."""
        keys, count = self.keys[: self.held], len(self.targets)
        keys.sort()
        # whole targets of some cells, one target at least
        begin, at = np.searchsorted(keys, np.arange(count + 1) << (self.bits + 2)), 0
        while at < count:
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + CELLS // 2, "right")) - 1)
            to = min(to, count)
            own = keys[begin[at] : begin[to]]
            cell = own >> 2
            starts = np.flatnonzero(np.concatenate((cell[:1] == cell[:1], cell[1:] != cell[:-1])))
            flags = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (own & 3).astype(np.uint8)), starts) if len(starts) else np.zeros(0, np.uint8)
            hit = cell[starts]
            x, y = np.searchsorted(self.cells, (at << self.bits, to << self.bits))
            cells, since, degree = self.cells[x:y], self.since[x:y], [g[x:y] for g in self.degree]
            place = np.searchsorted(hit, cells)
            there = np.flatnonzero(hit[np.minimum(place, len(hit) - 1)] == cells) if len(hit) else np.zeros(0, int)
            was, got = np.zeros(len(hit), np.uint8), [np.zeros(len(hit), np.uint8) for _ in degree]
            was[place[there]] = since[there]
            for r, g in enumerate(got):
                g[place[there]] = degree[r][there]
                seen, up = flags >> (2 * r) & 3 > 0, flags >> (2 * r + 1) & 1 > 0
                g[np.where(was == 0, seen, up & (was == d - 1)) & (g == 0)] = d
            was[was == 0] = d
            other = np.setdiff1d(np.arange(len(cells)), there, assume_unique=True)
            put = lambda into, what: np.insert(into, place[other], what[other])  # noqa: B023, E731
            yield at, to, put(hit, cells), put(was, since), [put(g, degree[r]) for r, g in enumerate(got)]
            at = to

    def around(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """As :meth:`Near.around`."""
        if self.first is None:
            return
        mask, pages, (step, page), mine = (1 << self.bits) - 1, self.parts, self.first, []
        while step == 0:
            n = page["n"].to_numpy()
            mine.append(page.filter(pa.array((n >= self.lo) & (n <= self.hi) & page["own"].to_numpy())))
            step, page = next(pages, (self.degrees, None))
        if not mine:
            raise RuntimeError("pages of a step came after those of the next")
        mine = pa.concat_tables(mine).sort_by("n")
        self.targets = mine["n"].to_numpy() - self.base
        row, node = np.arange(len(self.targets)), self.targets
        self.cells = row << self.bits | node
        self.since, self.degree = np.full(len(row), 255, np.uint8), [np.zeros(len(row), np.uint8) for _ in range(2)]
        self.keys, self.held = np.empty(FOUND, np.int64), 0
        if len(row):
            self._step(mine, row, node)
        for d in range(1, self.degrees):
            made = [x[2:] for x in self._merged(d)]
            if made:
                self.cells, self.since = (np.concatenate([x[i] for x in made]) for i in range(2))
                self.degree = [np.concatenate([x[2][r] for x in made]) for r in range(2)]
            new = self.cells[self.since == d]
            row, node = new >> self.bits, new & mask
            by = np.argsort(node, kind="stable")
            row, node, self.held = row[by], node[by], 0
            while step == d:
                self._step(page, row, node)
                step, page = next(pages, (self.degrees, None))
        for at, to, cells, since, degree in self._merged(self.degrees):
            found = np.flatnonzero(since < 255)
            yield self.targets[at:to], (cells[found] >> self.bits) - at, cells[found] & mask, [g[found] for g in degree]


class Block:
    """What is around the targets of a block."""

    def __init__(self, space: Near | Far) -> None:
        self.space, self.degrees, self.into, self.facts = space, space.degrees, space.into, space.facts
        self.around, self.address, self.fact_of = space.around, space.address, space.fact_of


class Candidates(Block):
    """The user-like neighbours of targets. What is known of a candidate but for its target is one of few variants of a function: a number of its
    function, degree, role and whether it calls the target. Functions of equal tokens and callees are a class, and orders are found once a block, among
    variants of classes, so that a target's candidates are put in order by whole numbers."""

    def __init__(self, space: Near | Far) -> None:
        super().__init__(space)
        self.tokens, likely = self.facts["token_count"].to_numpy().astype(np.int64), self.facts["likely"].to_numpy(zero_copy_only=False).astype(bool)
        callees = self.facts["n_callees"].to_numpy().astype(np.int64)
        self.user = np.flatnonzero(likely)  # rows of facts, in order of address
        self.addr = self.facts["n"].to_numpy()[self.user]
        self.slot = np.full(len(likely) + 1, -1)
        self.slot[self.user] = np.arange(len(self.user))
        self.each_has = self.degrees * 4
        some, value = np.unique(self.tokens[self.user], return_inverse=True)
        pair = callees[self.user] * max(1, len(some)) + value
        pair, self.cls = np.unique(pair, return_inverse=True)
        self.c_callees, value = np.divmod(pair, max(1, len(some)))
        self.c_tokens = some[value] if len(some) else some
        w = np.arange(len(pair) * self.each_has)
        self.w_score = self._score(w, float(fixed.BASE_SCORE))

    def _score(self, w: np.ndarray, s: float | np.ndarray) -> np.ndarray:
        """One round of the changes of :func:`selection.score`, in the same order."""
        c = w // self.each_has
        return ((s + self.calls(w) * float(fixed.CALLS_TARGET_BONUS)) - self.c_callees[c] * float(fixed.CALLEE_COST)) - (self.degree(w) - 1) * float(fixed.DEGREE_COST) - self.c_tokens[c] / fixed.TOKENS_PER_POINT

    def variant_of_class(self, v: np.ndarray) -> np.ndarray:
        slot, k = np.divmod(v, self.each_has)
        return self.cls[slot] * self.each_has + k

    def degree(self, v: np.ndarray) -> np.ndarray:
        return v // 4 % self.degrees + 1

    def role(self, v: np.ndarray) -> np.ndarray:
        return v // 2 % 2

    def calls(self, v: np.ndarray) -> np.ndarray:
        return v % 2

    def fact_row(self, v: np.ndarray) -> np.ndarray:
        return self.user[v // self.each_has]

    def token(self, v: np.ndarray) -> np.ndarray:
        return self.c_tokens[self.cls[v // self.each_has]]

    def address_of(self, v: np.ndarray) -> np.ndarray:
        return self.addr[v // self.each_has]

    def score(self, v: np.ndarray) -> np.ndarray:
        return self.w_score[self.variant_of_class(v)]

    def twice(self, v: np.ndarray) -> np.ndarray:
        """The score of a second phase."""
        w = np.arange(len(self.w_score))
        return self._score(w, self.w_score)[self.variant_of_class(v)]

    def order(self, by_score: bool, by_tokens: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The place of each class's variants by score, tokens, degree and callers first, as far as asked, equal ones the same; and a variant's
        number but for its function and whether it calls, by place."""
        w = np.arange(len(self.w_score))
        keys = [*([-self.w_score] if by_score else []), *([self.c_tokens[w // self.each_has]] if by_tokens else []), self.degree(w), self.role(w)]
        by = np.lexsort(keys[::-1])
        new = np.zeros(len(by), bool)
        for key in keys:
            new[1:] |= key[by[1:]] != key[by[:-1]]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        new[:1] = True
        return rank, by[new] % self.each_has // 2 * 2

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For batches: the targets, and for each candidate the number of its target and its variant, by target and address."""
        for ts, row, node, degree in self.around():
            slot = self.slot[self.fact_of(node)]
            kept = slot >= 0
            row, slot, caller, callee = row[kept], slot[kept], degree[0][kept], degree[1][kept]
            first = np.where(caller > 0, caller, callee).astype(np.int64)
            yield ts, row, ((slot * self.degrees + first - 1) * 2 + (caller == 0)) * 2 + ((caller, callee)[self.into] == 1)

    def ranked(self, row: np.ndarray, v: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The variants of each target in order, equal ones by address."""
        rank, rest = order
        if not len(v):
            return v
        many, ranks = len(self.user), len(rest)
        key = np.sort(((row * ranks + rank[self.variant_of_class(v)]) * many + v // self.each_has) * 2 + v % 2)
        place, slot = np.divmod(key >> 1, many)
        return slot * self.each_has + rest[place % ranks] + (key & 1)


def fold(tokens: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Places of what is taken in turn, as long as anything is left, where it fits; and what is left."""
    out, at = [], 0
    while left > 0 and at < len(tokens):
        fits = np.flatnonzero(tokens[at:] <= left)
        if not len(fits):
            break
        at += int(fits[0])
        total = np.cumsum(tokens[at:])
        # the run that is taken as a whole: each fits, and something is left ahead of each
        stop = np.flatnonzero((total > left) | (total - tokens[at:] >= left))
        n = int(stop[0]) if len(stop) else len(total)
        out.append(np.arange(at, at + n))
        left -= int(total[n - 1])
        at += n
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), left


def _batch(schema: pa.Schema, binary: str, columns: dict) -> pa.RecordBatch:
    size = len(columns["target"])
    columns = columns | {"binary_id": pa.repeat(pa.scalar(binary, pa.string()), size)}
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c).cast(t.type) for t in schema for c in [columns[t.name]]], schema=schema)


def _lists(row: np.ndarray, size: int, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=size)))), pa.int32()), values)


def neighbours(block: Block) -> Iterator[dict]:
    for ts, row, node, degree in block.around():
        none = {r: pa.array(d.astype(np.int32), mask=d == 0) for r, d in zip(("caller", "callee"), degree, strict=True)}
        yield {"target": block.address(ts[row]), "addr": block.address(node), **none}


def by_role(block: Block) -> Iterator[dict]:
    for ts, row, node, degree in block.around():
        for calls, d in zip((True, False), degree, strict=True):
            has = np.flatnonzero(d)
            yield {"target": block.address(ts[row[has]]), "addr": block.address(node[has]), "calls": np.full(len(has), calls), "degree": d[has].astype(np.int32)}


def counts(block: Block) -> Iterator[dict]:
    for ts, row, _, degree in block.around():
        n = [np.bincount(row[d > 0], minlength=len(ts)) for d in degree]
        some = (n[0] + n[1]) > 0
        yield {"target": block.address(ts[some]), "n_callers": n[0][some], "n_callees": n[1][some]}


def _facts(block: Candidates, v: np.ndarray, wanted: list[str]) -> dict:
    """Columns of candidates by their variants."""
    made = {
        "addr": lambda: block.address_of(v),
        "role": lambda: pa.array(["caller", "callee"]).take(pa.array(block.role(v))),
        "degree": lambda: block.degree(v),
        "name": lambda: block.facts["name"].combine_chunks().take(pa.array(block.fact_row(v))),
        "token_count": lambda: block.token(v),
        "is_leaf": lambda: block.facts["is_leaf"].to_numpy(zero_copy_only=False).astype(bool)[block.fact_row(v)],
        "n_callees": lambda: block.c_callees[block.cls[v // block.each_has]],
        "calls_target": lambda: block.calls(v) == 1,
        "score": lambda: block.score(v),
    }
    return {c: made[c]() for c in wanted if c in made}


def rows(block: Candidates, wanted: list[str]) -> Iterator[dict]:
    for ts, row, v in block.each():
        yield {"target": block.address(ts[row]), **_facts(block, v, wanted)}


def bundles(block: Candidates) -> Iterator[dict]:
    order = block.order(False)
    for ts, row, v in block.each():
        v = block.ranked(row, v, order)
        some = np.unique(row)
        total = np.bincount(row, block.token(v), len(ts))[some].astype(np.int64)
        got = _facts(block, v, ["name", "addr"])
        packed = np.searchsorted(some, row)
        yield {"target": block.address(ts[some]), "func_names": _lists(packed, len(some), got["name"]), "addrs": _lists(packed, len(some), pa.array(got["addr"])), "total_token_count": total}


def levels(block: Candidates) -> Iterator[dict]:
    for ts, row, v in block.each():
        low = np.full(len(ts), 256)
        np.minimum.at(low, row, block.degree(v))
        at = block.degree(v) == low[row]
        some = np.flatnonzero(low < 256)
        total = np.zeros(len(ts), np.int64)
        np.add.at(total, row[at], block.token(v[at]))
        yield {"target": block.address(ts[some]), "min_degree": low[some], "level_tokens": total[some]}


def important(block: Candidates, n: int) -> Iterator[dict]:
    order = block.order(True)
    for ts, row, v in block.each():
        v = block.ranked(row, v, order)
        some, begin = np.unique(row, return_index=True)
        best = np.arange(len(row)) - begin[np.searchsorted(some, row)] < n
        yield {"target": block.address(ts[some]), "addrs": _lists(np.searchsorted(some, row[best]), len(some), pa.array(block.address_of(v[best])))}


def groups(block: Candidates, left: int) -> Iterator[dict]:
    """By degree, in order of address."""
    for ts, row, v in block.each():
        # a function is a target's candidate once
        key, slot = np.divmod(np.sort((row * 256 + block.degree(v)) * len(block.user) + v // block.each_has), max(1, len(block.user)))
        some, begin, size = np.unique(key, return_index=True, return_counts=True)
        v = slot * block.each_has
        tokens = block.token(v)
        picked = [b + fold(tokens[b : b + n], left)[0] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
        ids = block.address_of(v[np.concatenate([*picked, np.zeros(0, np.int64)]).astype(np.int64)])
        yield {"target": block.address(ts[some // 256]), "degree": some % 256, "picked": _lists(np.repeat(np.arange(len(some)), [len(p) for p in picked]).astype(np.int64), len(some), pa.array(ids, pa.int64()))}


def level_of(left: int, budget: int) -> int | None:
    low, mid = (share * budget for share in fixed.LEVEL_SHARES)
    return None if left <= 0 else 2 if left <= low else 1 if left <= mid else 0


def chosen(block: Candidates, budget: int) -> Iterator[tuple[np.ndarray, list]]:
    """For batches: the targets that are known functions, and of each its level, chosen variants in order and how many came first as important."""
    by_tokens, by_score = block.order(True, True), block.order(True)
    for ts, row, v in block.each():
        ranked, begin = block.ranked(row, v, by_tokens), np.searchsorted(row, np.arange(len(ts) + 1))
        of, out = block.fact_of(ts), []
        known = of >= 0
        for i in np.flatnonzero(known).tolist():
            left = budget - int(block.tokens[of[i]])
            level, mine, first = level_of(left, budget), ranked[begin[i] : begin[i + 1]], np.zeros(0, np.int64)
            if level not in (0, 1):
                out.append((level, first, 0))
                continue
            if level == 1:
                best = block.ranked(np.zeros(len(mine), np.int64), mine, by_score)[: fixed.IMPORTANT]
                best = best[block.token(best) <= fixed.LARGE_SHARE * budget]
                taken, left = fold(block.token(best), left)
                first = best[taken]
                mine = mine[~np.isin(mine, first)]
            out.append((level, np.concatenate((first, mine[fold(block.token(mine), left)[0]])), len(first)))
        yield ts[known], out


def selected(block: Candidates, budget: int) -> Iterator[dict]:
    for ts, out in chosen(block, budget):
        ids = [block.address_of(v) for _, v, _ in out]
        status = [{None: "no_budget", 2: "level2_unimplemented"}.get(level, "ok") for level, _, _ in out]
        picked = _lists(np.repeat(np.arange(len(out)), [len(x) for x in ids]).astype(np.int64), len(out), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]), pa.int64()))
        yield {"target": block.address(ts), "level": pa.array([x[0] for x in out], pa.int32()), "status": pa.array(status, pa.string()), "picked": picked, "n_important": pa.array([x[2] for x in out], pa.int32())}


def picked(block: Candidates, budget: int, wanted: list[str]) -> Iterator[dict]:
    """A row for each that was chosen; those of a second phase have been scored twice."""
    for ts, out in chosen(block, budget):
        sizes = np.array([len(v) for _, v, _ in out], np.int64)
        v = np.concatenate([*(v for _, v, _ in out), np.zeros(0, np.int64)]).astype(np.int64)
        place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        again = np.repeat([x[0] == 1 for x in out], sizes).astype(bool) & (place >= np.repeat([x[2] for x in out], sizes))
        yield {"target": block.address(np.repeat(ts, sizes)), "sel_ord": place, **_facts(block, v, [c for c in wanted if c != "score"]), "score": np.where(again, block.twice(v), block.score(v))}


def run(parts: Iterator[pa.RecordBatch], make, kind: type[Block], degrees: int, corrected: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A group's rows to what ``make`` finds, as batches of ``schema``."""
    table = pa.Table.from_batches(list(parts))
    binary = table["binary_id"][0].as_py()
    for columns in make(kind(Near(table, degrees, corrected))):
        if len(columns["target"]):
            yield _batch(schema, binary, columns)


def run_far(parts: Iterator[pa.RecordBatch], make, kind: type[Block], degrees: int, corrected: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The same for pages that pass by a block."""
    space = Far(parts, degrees, corrected)
    if space.first is not None:
        for columns in make(kind(space)):
            if len(columns["target"]):
                yield _batch(schema, space.binary, columns)


def packed(parts: Iterator[pa.RecordBatch], columns: list[str], base: dict) -> Iterator[pa.RecordBatch]:
    """The rows of a page as one value in pieces, each with how many ``more`` follow, in order of ``n``, numbers of lists less the binary's ``base`` and as short as they may be."""
    rows = pa.Table.from_batches(list(parts))
    binary, page, made = rows["binary_id"][0], rows["page"][0], rows.select(columns).sort_by("n").combine_chunks()
    for c in ("outs", "ins"):
        if c in columns:
            low, bits = base[binary.as_py()]
            sizes, values = _flat(made[c])
            values = (values.astype(np.int64) - low).astype(np.int32 if bits < 32 else np.int64)
            made = made.set_column(made.column_names.index(c), c, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    whole = sink.getvalue()
    pieces = [whole[i : i + PIECE].to_pybytes() for i in range(0, whole.size, PIECE)]
    n = len(pieces)
    yield pa.RecordBatch.from_arrays([pa.array([binary.as_py()] * n, pa.string()), pa.array([page.as_py()] * n, pa.int64()), pa.array(np.arange(n)[::-1].astype(np.int32)), pa.array(pieces, pa.binary())], ["binary_id", "page", "more", "packed"])
