"""External induced sorting of the suffixes of a byte string, with common-prefix values.

Suffixes wait in queues, one per first character, in the order in which scanning meets
them; as every scan pushes only to characters on its far side, taking the queues in
character order is a monotone priority queue. Queue entries are tuples of a position and
the length of the prefix shared with the entry before. The order of the leftmost-S
suffixes comes from sorting the string of their names, recursively; a string of names
that fits in the memory given is ordered there, by prefix doubling.

Everything that grows with the string lies in files of the task's own temporary folder
once it is larger than a part of the memory given: the queues' blocks, and the string,
the directions, the leftmost-S places, their order, names and prefixes as mapped files,
which are read and written a block at a time. In memory stays, besides blocks, where each
waiting character's blocks lie: that is little for bytes, but some 300 bytes for each waiting
name on the levels of the recursion. The files have no name, so nothing stays when a task ends or its
executor is lost; the task is then run again.

Prefixes count up to a cap: suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

CAP = 200
#: Entries that a step works on.
MERGE = 1 << 18
FAR = np.int32(1 << 30)


class Store:
    """Arrays for a share of the memory given, beyond that as mapped files without a name."""

    def __init__(self, memory: int):
        self.memory = memory
        self.block = max(64, min(MERGE, memory // 64))

    def array(self, n: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if n * kind.itemsize <= self.memory // 16:
            return np.zeros(n, kind)
        with tempfile.TemporaryFile() as f:
            f.truncate(n * kind.itemsize)
            return np.memmap(f, kind, "r+", shape=(n,))

    def blocks(self, n: int):
        """Bounds of successive blocks."""
        return ((i, min(n, i + self.block)) for i in range(0, n, self.block))


class Queues:
    """Blocks of (position, common prefix) by key, first in first out; spilled beyond `memory` bytes."""

    def __init__(self, memory: int, most: int = MERGE):
        self.memory, self.most, self.held, self.blocks, self.file = memory, most, 0, {}, None

    def push(self, key, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        self.blocks.setdefault(key, []).append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, blocks in self.blocks.items():
            for i, b in enumerate(blocks):
                if isinstance(b[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(b[0].tobytes())
                    self.file.write(b[1].tobytes())
                    blocks[i] = (at, len(b[0]))
        self.held = 0

    def load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)

    def pop(self, key, backwards: bool = False):
        """The key's entries in order, short blocks put together; backwards the blocks as they are, from the last to the first."""
        blocks = self.blocks.pop(key, [])
        group, n = [], 0
        for b in reversed(blocks) if backwards else blocks:
            if isinstance(b[0], np.ndarray):
                self.held -= b[0].nbytes + b[1].nbytes
            group.append(self.load(b))
            n += len(group[-1][0])
            if backwards or n >= self.most:
                yield joined(group)
                group, n = [], 0
        if group:
            yield joined(group)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def joined(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    return blocks[0] if len(blocks) == 1 else (np.concatenate([p for p, _ in blocks]), np.concatenate([l for _, l in blocks]))


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, up to the cap."""
    n = len(t)
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    k = 0
    if t.dtype == np.uint8 and n >= 8:
        # eight bytes at a time while both have them
        wide = np.ndarray(n - 7, "<u8", np.ascontiguousarray(t), strides=(1,))
        rest = []
        while k < cap and len(live):
            x, y = a[live] + k, b[live] + k
            inside = np.maximum(x, y) <= n - 8
            if not inside.all():
                rest.append(live[~inside])
                out[rest[-1]] = k
                live, x, y = live[inside], x[inside], y[inside]
            apart = wide[x] ^ wide[y]
            # trailing zero bits: the bytes that agree
            agree = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            out[live] = k + agree
            live = live[apart == 0]
            k += 8
        live = np.concatenate(rest) if rest else live[:0]
        np.minimum(out, cap, out=out)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        live = live[(x < n) & (y < n) & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]) & (out[live] < cap)]
        out[live] += 1
    return out


class Inducer:
    """One string: its types, its buckets, and the two scans."""

    def __init__(self, t: np.ndarray, store: Store, cap: int, names: int | None = None):
        """names: how many names the string is made of (0 and up, each used), if it isn't one of bytes."""
        self.t, self.n, self.store, self.cap, self.names = t, len(t), store, cap, names
        n = self.n
        #: Whether a suffix is less than the next: a place has the direction of the next change, the end counts as a fall.
        self.small = store.array(n, bool)
        rises = False
        for i, j in reversed(list(store.blocks(n))):
            x = np.asarray(t[i : min(j + 1, n)]).astype(np.int64)
            step = np.append(np.sign(np.diff(x)), [] if j < n else [-1])
            at = np.where(step != 0, np.arange(len(step)), len(step))
            at = np.minimum.accumulate(at[::-1])[::-1]
            self.small[i:j] = np.append(step > 0, rises)[at]
            rises = bool(self.small[i])
        total = 0
        for i, j in store.blocks(n):
            total += int(np.count_nonzero(self.stars_in(i, j)))
        self.lms = store.array(total, np.int64)
        at = 0
        for i, j in store.blocks(n):
            found = np.flatnonzero(self.stars_in(i, j)) + i
            self.lms[at : at + len(found)] = found
            at += len(found)

    def stars_in(self, i: int, j: int) -> np.ndarray:
        """Which places from i to j are leftmost-S: small after a place that isn't."""
        x = np.asarray(self.small[max(i - 1, 0) : j])
        return np.append([False] if i == 0 else [], x[1:] & ~x[:-1]).astype(bool)

    def scan(self, queues: Queues, since: dict, pos, lcp, small: bool, want) -> None:
        """Pushes what the scanned entries induce. since: by character, the least prefix scanned since its last push."""
        ok = pos > 0
        prev = pos[ok] - 1
        at = np.flatnonzero(ok)
        kind = self.small[prev] == small
        prev, at = prev[kind], at[kind]
        low = int(lcp.min()) if len(lcp) else FAR
        if len(prev):
            chars = self.t[prev]
            order = np.argsort(chars, kind="stable")
            cut = np.flatnonzero(np.diff(chars[order].astype(np.int64), prepend=-1)).tolist() + [len(order)]
            hit = set()
            for i, j in zip(cut, cut[1:]):
                rows = order[i:j]
                d = int(chars[rows[0]])
                hit.add(d)
                if want:
                    ends = at[rows]
                    # minima over (end before, end], the first from the block's start
                    got = np.minimum.reduceat(lcp[: ends[-1] + 1], np.concatenate(([0], ends[:-1] + 1)))
                    tail = int(lcp[ends[-1] + 1 :].min()) if ends[-1] + 1 < len(lcp) else int(FAR)
                    got[0] = min(int(got[0]), since[d]) if d in since else -1
                    since[d] = tail
                    push = np.minimum(got + 1, self.cap).astype(np.int32)
                else:
                    push = np.zeros(j - i, np.int32)
                queues.push(d, prev[rows], push)
        else:
            hit = ()
        if want:
            for d in since:
                if d not in hit and since[d] > low:
                    since[d] = low

    def run(self, stars: np.ndarray, star_lcp: np.ndarray | None, want: bool = True):
        """stars: the leftmost-S places in order. Yields blocks of places and prefixes, the last suffixes first; within a block in suffix order.

        A block's first prefix is the one shared with the last place of the block that comes after it here.
        """
        t, memory, most = self.t, self.store.memory, self.store.block
        queues, kept = Queues(memory // 4, most), Queues(memory // 4, most)
        since: dict[int, int] = {}
        last: dict[int, int] = {}
        # the characters in order: those of the string, known from its least place on
        present = self.characters()
        at, n_stars = 0, len(stars)
        # the empty suffix comes first
        self.scan(queues, since, np.array([self.n]), np.zeros(1, np.int32), False, want)
        for c in present:
            while c in queues.blocks:
                # what arrives for c itself while c is scanned is scanned after it
                for pos, lcp in queues.pop(c):
                    kept.push(c, pos, lcp)
                    self.scan(queues, since, pos, lcp, False, want)
                    if want:
                        last[c] = int(pos[-1])
            first = True
            while at < n_stars:
                some = np.asarray(stars[at : at + most])
                some = some[: int(np.searchsorted(t[some], c, "right"))]
                if not len(some):
                    break
                lcp = np.array(star_lcp[at : at + len(some)], np.int32) if want else np.zeros(len(some), np.int32)
                if want and first:
                    lcp[0] = common(t, np.array([last[c]]), some[:1], self.cap)[0] if c in last else 0
                self.scan(queues, since, some, lcp, False, want)
                first, at = False, at + len(some)
        queues.close()
        queues = Queues(memory // 4, most)
        since = {}
        for c in reversed(present):
            end = None
            told = Queues(memory // 4, most)
            while c in queues.blocks:
                for pos, lcp in queues.pop(c):
                    told.push(0, pos, lcp)
                    self.scan(queues, since, pos, lcp, True, want)
                    end = int(pos[-1])
            link = 0
            if want and end is not None and c in last:
                link = int(common(t, np.array([last[c]]), np.array([end]), self.cap)[0])
            # they came from the greatest to the least: each one's prefix is that shared with the one before, which is the next in order
            held = None
            for pos, lcp in told.pop(0):
                if held is not None:
                    yield held[0][::-1], np.append(held[1][1:], lcp[:1])[::-1].astype(np.int32)
                held = pos, lcp
            if held is not None:
                yield held[0][::-1], np.append(held[1][1:], link)[::-1].astype(np.int32)
            told.close()
            before = link
            for pos, lcp in kept.pop(c, backwards=True):
                # scanned from the right, an entry's prefix is that of the entry on its right
                self.scan(queues, since, pos[::-1], np.concatenate(([before], lcp[:0:-1])).astype(np.int32), True, want)
                before = int(lcp[0])
                yield pos, lcp
        queues.close()
        kept.close()

    def characters(self) -> list[int] | range:
        if self.names is not None:
            return range(self.names)
        found = np.zeros(0, np.int64)
        for i, j in self.store.blocks(self.n):
            found = np.union1d(found, np.asarray(self.t[i:j]).astype(np.int64))
        return found.tolist()


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by the first depth of them at least, in memory."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:-k or None] += (rank[k:] + 1) if k < len(rank) else 0
        if k >= len(rank):
            key = rank
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(rank), np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if new.max() == len(new) - 1 or 2 * k >= depth or k >= len(rank):
            return order
        rank, k = new, 2 * k


def named(ind: Inducer, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings, by place, given their order; and how many names there are. Substrings that agree up to the cap share a name."""
    t, lms, n, store = ind.t, ind.lms, ind.n, ind.store
    names = store.array(len(lms), np.int64)
    count = 0
    for i, j in store.blocks(len(ordered)):
        # one entry of the block before, to compare with
        some = np.asarray(ordered[max(i - 1, 0) : j])
        where = np.searchsorted(lms, some)
        # up to and with the next leftmost-S place; the last reaches over the end
        follows = np.where(where + 1 < len(lms), lms[np.minimum(where + 1, len(lms) - 1)], n)
        size = follows - some + 1
        same = size[1:] == size[:-1]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            a, b = some[live] + k, some[live + 1] + k
            inside = k < np.minimum(size[live], ind.cap)
            ended = (a >= n) | (b >= n)
            equal = (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)]) & ~ended
            same[live[inside & ~equal]] = False
            live = live[inside & equal]
            k += 1
        new = np.cumsum(~same) + count
        if i == 0:
            new = np.append(0, new)
        else:
            where = where[1:]
        names[where] = new
        count = int(new[-1])
    return names, count + 1


def by_character(ind: Inducer) -> np.ndarray:
    """The leftmost-S places by their first character, dealt block by block to where each character's places begin."""
    t, lms, store = ind.t, ind.lms, ind.store
    n = 0
    for i, j in store.blocks(len(lms)):
        n = max(n, int(t[lms[i:j]].max()) + 1)
    starts = store.array(n + 1, np.int64)
    for i, j in store.blocks(len(lms)):
        c, often = np.unique(t[lms[i:j]], return_counts=True)
        starts[c.astype(np.int64) + 1] += often
    total = 0
    for i, j in store.blocks(n + 1):
        starts[i:j] = np.cumsum(starts[i:j]) + total
        total = int(starts[j - 1])
    out = store.array(len(lms), np.int64)
    for i, j in store.blocks(len(lms)):
        some = np.asarray(lms[i:j])
        c = t[some].astype(np.int64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        often = np.diff(np.append(first, len(c)))
        nth = np.arange(len(c)) - np.repeat(first, often)
        out[starts[c] + nth] = some[order]
        starts[c[first]] += often
    return out


def gather(found, total: int, store: Store, mark: np.ndarray | None = None) -> np.ndarray:
    """The places that a run yields, in suffix order; only the marked ones if marks are given."""
    out, at = store.array(total, np.int64), total
    for pos, _ in found:
        if mark is not None:
            pos = pos[mark[pos]]
        out[at - len(pos) : at] = pos
        at -= len(pos)
    return out


def order_of(t: np.ndarray, store: Store, cap: int, n_names: int | None = None) -> tuple[Inducer, np.ndarray]:
    """The string's inducer and its leftmost-S places in suffix order."""
    ind = Inducer(t, store, cap, n_names)
    lms = ind.lms
    if len(lms) < 2:
        return ind, lms
    mark = store.array(len(t), bool)
    for i, j in store.blocks(len(lms)):
        mark[lms[i:j]] = True
    ordered = gather(ind.run(by_character(ind), None, want=False), len(lms), store, mark)
    names, n_names = named(ind, ordered)
    if n_names == len(names):
        return ind, ordered
    if 64 * len(names) <= store.memory:
        # successive places are two apart at least
        places = doubled(names, -(-cap // 2))
    else:
        inner, stars = order_of(names, store, cap, n_names)
        places = gather(inner.run(stars, None, want=False), len(names), store)
    out = store.array(len(lms), np.int64)
    for i, j in store.blocks(len(lms)):
        out[i:j] = lms[places[i:j]]
    return ind, out


def suffixes(t: np.ndarray, memory: int = 256 << 20, cap: int = CAP):
    """Yields blocks, the last suffixes first, of places in suffix order and the prefixes shared with the place before (also where that is in the next block; the first suffix has 0)."""
    if not len(t):
        return
    store = Store(memory)
    ind, stars = order_of(t, store, cap)
    lcp = store.array(len(stars), np.int32)
    for i, j in store.blocks(len(stars)):
        some = np.asarray(stars[max(i - 1, 0) : j])
        if len(some) > 1:
            lcp[j - len(some) + 1 : j] = common(t, some[:-1], some[1:], cap)
    yield from ind.run(stars, lcp)
