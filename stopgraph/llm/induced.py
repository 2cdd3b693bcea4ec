"""Suffix sorting by recursive external induction, with common-prefix values carried along.

Suffixes are typed S or L as in induced sorting.  The substrings between LMS positions are
sorted by an induction and named; where names repeat, the string of names is sorted by the
same procedure, a level further down, and the order of the LMS suffixes found there seeds
the induction of all others.  A string of no more than ``BASE`` names ends the recursion and
is sorted in memory.  Values of what neighbours share go the same way: those of the
names are turned into characters, and each induced suffix shares one character more with
the one before it in its bucket than the least of what lies between their inducers.

A scan does not work on an array of suffixes but on a priority queue of tuples (key,
position, shared), ordered by key and then by insertion.  A queue is a list of sorted runs;
runs beyond its budget go to files of the shared folder and are read back block by block.
Tuples are taken in batches, as far as none of a batch induces one that comes before a later
one of it, so a scan is a few array operations for each batch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs

#: Names that are sorted in memory, by doubling, where the recursion ends.
BASE = 1 << 18
#: Tuples that a run in a file is read by, and that a batch has at least and at most.
BLOCK, BATCH = 1 << 14, (64, 1 << 15)
_TUPLE = np.dtype([("key", "<i4"), ("position", "<i4"), ("shared", "u1")])


class Files:
    """Files of one task in a folder that executors share, gone once they are read."""

    def __init__(self, folder: str):
        self.store, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.written = 0

    def open(self) -> tuple[str, pyarrow.NativeFile]:
        self.store.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        return path, self.store.open_output_stream(path, buffer_size=1 << 16)

    def write(self, body: bytes) -> str:
        path, stream = self.open()
        with stream:
            stream.write(body)
        self.written += len(body)
        return path

    def read(self, path: str) -> pyarrow.NativeFile:
        return self.store.open_input_stream(path, buffer_size=1 << 16)

    def remove(self, path: str) -> None:
        self.store.delete_file(path)


class _Run:
    """Sorted tuples: those in memory from ``at`` on, then ``left`` ones of a file."""

    __slots__ = ("at", "key", "left", "path", "position", "shared", "stream")

    def __init__(self, key: np.ndarray, position: np.ndarray, shared: np.ndarray):
        self.key, self.position, self.shared, self.at = key, position, shared, 0
        self.left, self.path, self.stream = 0, None, None

    def __len__(self) -> int:
        return len(self.key) - self.at + self.left

    def held(self) -> int:
        return (len(self.key) - self.at) * _TUPLE.itemsize


class TupleQueue:
    """A priority queue of tuples, in memory up to ``budget`` bytes and in files beyond.

    Without ``files`` all tuples stay in memory.
    """

    def __init__(self, budget: int, files: Files | None = None):
        self.budget, self.files = budget, files
        self.runs: list[_Run] = []

    def push(self, key: np.ndarray, position: np.ndarray, shared: np.ndarray) -> None:
        """Add tuples in order of their keys; of equal keys those added first come first."""
        if not len(key):
            return
        self.runs.append(_Run(key, position, shared))
        # runs in memory grow from the last to the first, so they are few
        while len(self.runs) > 1 and self.runs[-2].path is None and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            b, a = self.runs.pop(), self.runs.pop()
            key = np.concatenate([a.key[a.at :], b.key[b.at :]])
            order = np.argsort(key, kind="stable")
            self.runs.append(_Run(key[order], np.concatenate([a.position[a.at :], b.position[b.at :]])[order], np.concatenate([a.shared[a.at :], b.shared[b.at :]])[order]))
        if self.files is not None and sum(r.held() for r in self.runs) > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write the longest runs in memory to files until half of the budget is free."""
        for run in sorted((r for r in self.runs if r.path is None), key=lambda r: -r.held()):
            if run.held() <= BLOCK * _TUPLE.itemsize:
                break
            out = np.empty(len(run.key) - run.at, _TUPLE)
            out["key"], out["position"], out["shared"] = run.key[run.at :], run.position[run.at :], run.shared[run.at :]
            run.path, run.left, run.at = self.files.write(out.tobytes()), len(out), 0
            run.key, run.position, run.shared = run.key[:0], run.position[:0], run.shared[:0]
            if sum(r.held() for r in self.runs) <= self.budget // 2:
                break

    def _fill(self, run: _Run, n: int) -> None:
        if not run.left or len(run.key) - run.at >= n:
            return
        if run.stream is None:
            run.stream = self.files.read(run.path)
        take = min(run.left, max(n, BLOCK))
        new = np.frombuffer(run.stream.read(take * _TUPLE.itemsize), _TUPLE)
        run.key = np.concatenate([run.key[run.at :], new["key"]])
        run.position = np.concatenate([run.position[run.at :], new["position"]])
        run.shared = np.concatenate([run.shared[run.at :], new["shared"]])
        run.at, run.left = 0, run.left - take

    def peek(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first tuples, some ``n`` of them, and the run that each is in."""
        bound, block = None, max(BATCH[0], n // max(1, len(self.runs)))
        for k, run in enumerate(self.runs):
            self._fill(run, block)
            if len(run) > block and (bound is None or run.key[run.at + block - 1] < bound[0]):
                bound = (run.key[run.at + block - 1], k)
        key, position, shared, which = [], [], [], []
        for k, run in enumerate(self.runs):
            end = min(run.at + block, len(run.key))
            if bound is not None:  # beyond that key some run may have more than was looked at
                end = run.at + int(np.searchsorted(run.key[run.at : end], bound[0], "right" if k <= bound[1] else "left"))
            if end > run.at:
                key.append(run.key[run.at : end])
                position.append(run.position[run.at : end])
                shared.append(run.shared[run.at : end])
                which.append(np.full(end - run.at, k, np.uint8))
        if len(key) == 1:
            return key[0], position[0], shared[0], which[0]
        if not key:
            none = np.zeros(0, np.int32)
            return none, none, np.zeros(0, np.uint8), none
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        return key[order], np.concatenate(position)[order], np.concatenate(shared)[order], np.concatenate(which)[order]

    def drop(self, which: np.ndarray) -> None:
        """Take out the first tuples; ``which`` tells their runs."""
        for k, n in enumerate(np.bincount(which, minlength=len(self.runs)).tolist()):
            self.runs[k].at += n
        for run in self.runs:
            if run.path is not None and not len(run):
                run.stream.close()
                self.files.remove(run.path)
        self.runs = [r for r in self.runs if len(r)]


class Minima:
    """Least values of ranges of a sequence that grows by batches, each ending in the last batch.

    Of what came before a batch only the places are kept after which all values are larger:
    no more than there are values.
    """

    def __init__(self):
        self.place, self.value, self.n = np.zeros(0, np.int64), np.zeros(0, np.uint8), 0

    def least(self, batch: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least from ``begin``, anywhere, to ``end``, in the batch to be added; none is empty."""
        end = end - self.n
        out = np.minimum.accumulate(batch)[end]
        early = np.flatnonzero(begin < self.n)
        if len(early):
            at = np.searchsorted(self.place, begin[early])
            out[early] = np.minimum(out[early], self.value[at])
        late = np.flatnonzero(begin > self.n)
        if len(late):
            a, z = begin[late] - self.n, end[late]
            power = np.frexp(z - a + 1)[1] - 1  # the longest power of two within
            got, row = np.empty(len(late), np.uint8), batch
            for k in range(int(power.max()) + 1):
                if k:
                    row = np.minimum(row[: len(row) - (1 << k - 1)], row[1 << k - 1 :])
                here = np.flatnonzero(power == k)
                got[here] = np.minimum(row[a[here]], row[z[here] + 1 - (1 << k)])
            out[late] = got
        return out

    def add(self, batch: np.ndarray) -> None:
        """Append the batch; the places kept have values that grow towards the end."""
        back = np.minimum.accumulate(batch[::-1])
        first = np.flatnonzero(np.r_[True, back[1:] < back[:-1]])[::-1]
        kept = int(np.searchsorted(self.value, back[-1]))
        self.place = np.concatenate([self.place[:kept], self.n + len(batch) - 1 - first])
        self.value = np.concatenate([self.value[:kept], back[first]])
        self.n += len(batch)


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last counts as smaller."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """How many characters the suffixes at ``a`` and ``b`` share, up to ``cap``.

    The last character of ``text`` occurs once; ``known`` characters need not be compared.
    """
    n = len(text)
    done = np.zeros(len(a), np.int64) if known is None else np.minimum(known, cap).astype(np.int64)
    open_ = np.flatnonzero(done < cap)
    width = 8 if text.dtype == np.uint8 else 1
    if width == 8:
        padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1))
    while len(open_):
        x, y = np.minimum(a[open_] + done[open_], n - 1), np.minimum(b[open_] + done[open_], n - 1)
        if width == 8:
            x, y = words[x].copy().view(">u8")[:, 0], words[y].copy().view(">u8")[:, 0]
            same = x == y
            differ = (x ^ y)[~same].astype(np.uint64)
            # whole bytes above the first bit that differs
            lead = np.zeros(len(differ), np.int64)
            for k in range(1, 8):
                lead += differ < np.uint64(1 << (64 - 8 * k))
            done[open_[~same]] += lead
        else:
            same = (text[x] == text[y]) & (a[open_] != b[open_])
        open_ = open_[same]
        done[open_] += width
        open_ = open_[done[open_] < cap]
    return np.minimum(done, cap)


def _scan(text: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], small: np.ndarray, falling: bool, cap: int, budget: int, files: Files | None, carry: bool) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that ``seeds`` (positions, shared; in scanning order) induce, in scanning order.

    Rising scans induce L suffixes and falling ones S suffixes.  In the bucket of a character
    induced suffixes come before seeds, so their keys are even and those of seeds odd.
    """
    top = int(text.max())
    queue = TupleQueue(budget, files)
    number = (lambda c: 2 * (top - c.astype(np.int32))) if falling else (lambda c: 2 * c.astype(np.int32))
    queue.push(number(text[seeds[0]]) + np.int32(1), seeds[0].astype(np.int32), seeds[1].astype(np.uint8))
    never = np.iinfo(np.int32).max
    # the key of what each suffix induces
    induces = np.full(len(text), never, np.int32)
    some = np.flatnonzero(small[:-1] == falling)
    induces[some + 1] = number(text[some])
    minima, last = Minima(), np.full(2 * top + 2, -1, np.int64)
    found, found_shared, scanned, before_key, before_at, size = [], [], 0, -2, 0, 1024
    while True:
        key, position, shared, which = queue.peek(size)
        if not len(key):
            break
        target = induces[position]
        # a batch ends before the first tuple that one of its own comes before
        early = np.flatnonzero(np.minimum.accumulate(target)[:-1] < key[1:])
        m = int(early[0]) + 1 if len(early) else len(key)
        size = min(2 * size, BATCH[1]) if m == len(key) else max(2 * m, BATCH[0])
        queue.drop(which[:m])
        key, position, shared, target = key[:m], position[:m], shared[:m], target[:m]
        seed = (key & 1) == 1
        hits = np.flatnonzero(target != never)
        if carry:
            shared = shared.copy()
            one, two = np.empty(m, np.int32), np.empty(m, np.int32)
            one[0], one[1:], two[0], two[1:] = before_key, key[:-1], before_at, position[:-1]
            joint = np.flatnonzero(seed & (one == key - 1))  # seeds next to induced suffixes
            if len(joint):
                shared[joint] = shared_prefix(text, two[joint], position[joint], cap)
            shared[(one >> 1) != (key >> 1)] = 0  # another first character
            before_key, before_at = int(key[-1]), int(position[-1])
            if len(hits):
                order = np.argsort(target[hits], kind="stable")
                t, at = target[hits][order], hits[order] + scanned
                first, since = np.ones(len(t), bool), np.empty(len(t), np.int64)
                np.not_equal(t[1:], t[:-1], out=first[1:])
                since[1:] = at[:-1]
                since[first] = last[t[first]]
                last[t] = at  # of equal targets the last one stays
                # one character more than the least in between; nothing is before a bucket's first
                some = since >= 0
                gap = np.zeros(len(t), np.uint8)
                gap[some] = np.minimum(minima.least(shared, since[some] + 1, at[some]), cap - 1) + np.uint8(1)
                queue.push(t, position[hits][order] - np.int32(1), gap)
            minima.add(shared)
        else:
            order = np.argsort(target[hits], kind="stable")
            queue.push(target[hits][order], position[hits][order] - np.int32(1), np.zeros(len(hits), np.uint8))
        scanned += m
        found.append(position[~seed])
        found_shared.append(shared[~seed])
    return np.concatenate(found or [np.zeros(0, np.int32)]), np.concatenate(found_shared or [np.zeros(0, np.uint8)])


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, shared: np.ndarray, cap: int, budget: int, files: Files | None, carry: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """L and S suffixes in order from LMS ones in order, each with what it shares with the one before."""
    large, large_shared = _scan(text, (lms, shared), small, False, cap, budget, files, carry)
    down = np.r_[np.zeros(1, np.uint8), large_shared[::-1][:-1]][: len(large)]
    last = np.array([len(text) - 1], np.int32)  # the last suffix is induced by nothing
    # falling scans begin with the largest suffixes; the last one, of the least character, ends them
    less, less_shared = _scan(text, (np.r_[large[::-1], last], np.r_[down, np.zeros(1, np.uint8)]), small, True, cap, budget, files, carry)
    up = np.r_[np.zeros(1, np.uint8), np.zeros(1, np.uint8), less_shared[::-1][:-1]][: len(less) + 1]
    return large, large_shared, np.r_[last, less[::-1]], up


def _named(text: np.ndarray, lms: np.ndarray, in_order: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each LMS position's substring among all, equal ones alike, from one on; and places in that order."""
    index = np.searchsorted(lms, in_order)
    length = np.diff(np.r_[lms, len(text) - 1])[index]
    a, b, n = in_order[:-1], in_order[1:], length[1:]
    alike = np.flatnonzero((length[:-1] == n) | (np.minimum(length[:-1], n) >= cap))
    new = np.ones(len(in_order), bool)
    # substrings reach up to the next LMS position's character; beyond cap nothing is told apart
    most = np.minimum(n[alike] + 1, cap)
    for reach in (8, 64, cap):
        some = np.flatnonzero(most <= reach) if reach < cap else np.arange(len(alike))
        if len(some):
            got = shared_prefix(text, a[alike[some]], b[alike[some]], min(reach, cap))
            new[alike[some] + 1] = got < most[some]
        most, alike = np.delete(most, some), np.delete(alike, some)
    new[0] = True
    out = np.empty(len(lms), np.int32)
    out[index] = np.cumsum(new)
    return out, index


def _order(text: np.ndarray, cap: int, budget: int, files: Files | None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and what each shares with the one before; the last character is the least."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + np.int32(1)
    by_char = lms[np.argsort(text[lms], kind="stable")]
    *_, in_order, _ = _induce(text, small, by_char, np.zeros(len(lms), np.uint8), cap, budget, files, False)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    name, ranked = _named(text, lms, in_order[is_lms[in_order]], cap)
    # a level down: its last character, the last suffix's name, is the least and occurs once
    # and only names that repeat, and those next to them, need be looked at: a name that
    # occurs once ends any comparison
    once = np.bincount(name)[name] == 1
    kept = ~once
    kept[1:] |= ~once[:-1]
    kept[-1] = True
    kept = np.flatnonzero(kept)
    alike = np.zeros(len(lms), np.uint8)
    if len(kept) > 1:
        used = np.zeros(int(name.max()) + 1, np.int32)
        used[name[kept]] = 1
        string = np.cumsum(used, dtype=np.int32)[name[kept]]
        below, names = _doubled(string, cap // 2 + 2) if len(string) <= BASE else _order(string, cap // 2 + 2, budget, files)
        found = kept[below]
        alike[found] = names
        ranked[~once[ranked]] = found[~once[found]]  # both by name; there also by what follows
    names = np.where(once[ranked], 0, alike[ranked]).astype(np.int64)
    # equal names up to the end of the k-th substring
    at = lms[ranked]
    known = np.zeros(len(lms), np.int64)
    known[1:] = lms[np.minimum(ranked[1:] + names[1:], len(lms) - 1)] - at[1:]
    shared = np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        shared[1:] = shared_prefix(text, at[:-1], at[1:], cap, known[1:])
    large, large_shared, less, less_shared = _induce(text, small, at, shared, cap, budget, files, True)
    key = np.concatenate([2 * text[large].astype(np.int32), 2 * text[less].astype(np.int32) + np.int32(1)])
    place = np.argsort(key, kind="stable")
    key, order = key[place], np.concatenate([large, less])[place]
    prefix = np.concatenate([large_shared, less_shared])[place]
    joint = np.flatnonzero((key[1:] == key[:-1] + 1) & ((key[1:] & 1) == 1)) + 1  # the first S suffix behind L ones
    prefix[joint] = shared_prefix(text, order[joint - 1], order[joint], cap)
    prefix[np.r_[True, (key[1:] >> 1) != (key[:-1] >> 1)]] = 0
    return order, prefix


def _doubled(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_order`, in memory, by doubling the length that ranks tell apart."""
    n = len(text)
    rank, reach = np.zeros(n + 1, np.int64), 1
    rank[:-1] = text.astype(np.int64) + 1
    order = np.argsort(rank[:-1])
    levels = [(1, rank.astype(np.int32))]
    while reach < cap:
        key = rank[:-1] * (int(rank.max()) + 1) + rank[np.minimum(np.arange(n) + reach, n)]
        order = np.argsort(key)
        got = key[order]
        rank[order] = np.cumsum(np.r_[True, got[1:] != got[:-1]])
        reach *= 2
        if rank.max() == n:
            break
        levels.append((reach, rank.astype(np.int32)))
    # ranks of a level are equal where that many names are
    shared, a, b = np.zeros(n, np.uint8), order[:-1].copy(), order[1:].copy()
    done = np.zeros(len(a), np.int64)
    for reach, rank in reversed(levels):
        same = np.flatnonzero(rank[np.minimum(a + done, n)] == rank[np.minimum(b + done, n)])
        done[same] += reach
    shared[1:] = np.minimum(done, cap)
    return order.astype(np.int32), shared


def suffix_order(text: np.ndarray, cap: int = 200, budget: int = 64 << 20, files: Files | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and what each shares with the one before it.

    ``text`` has values from 1 to 255; orders and lengths hold as far as ``cap`` (at most
    255) characters, so suffixes that share that many may lie in any order.
    """
    text = np.concatenate([text.astype(np.uint8), np.zeros(1, np.uint8)])
    order, prefix = _order(text, cap, budget, files)
    return order[1:], prefix[1:]  # without the sentinel's own
