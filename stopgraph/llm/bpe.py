"""Byte-level BPE by speculation: propose greedily, verify adjacent pairs, repair the rest.

A word's tokens are first proposed by greedy longest match.  A sequence of tokens is what
merging would have made exactly if every adjacent pair is *compatible*: undoing the two
tokens' merges from the latest to the earliest, no merge across their border would have
come first.  That test runs on arrays of pairs for all new words together; only words
with a failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import released

#: The pattern that splits text into words, with Unicode's white space spelt out.
_WS = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Stands between words where many are matched at once; no byte maps to it.
_GAP = "\u0100"
#: Words kept between batches by one worker, and the longest that is kept.
CACHE_WORDS, CACHE_CHARS = 600_000, 48
#: Bytes up to which failing words are merged together; longer ones use a heap each.
SHORT = 64
#: Characters of text worked on at once, unless one text is longer.
CHUNK = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A tokenizer file's vocabulary, merges and special tokens, ready for array lookups."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in text)
        for text, i in self.specials.items():
            self.bytes[i] = text.encode()
        self.ids = {self.bytes[i]: i for i in vocab.values()}
        self.matcher = ahocorasick.Automaton()
        for raw, i in self.ids.items():
            self.matcher.add_word(raw.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.base = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.rank, self.made = {}, {}
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y], self.made[x, y] = r, z
            if self.born[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, r
        self.size = size
        self.base_ids = np.array(self.base, np.int64)
        self.rank_made = np.array(list(self.made.values()), np.int64)
        keys = np.array([x * size + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.arange(len(keys))[order]
        self.word = regex.compile(WORD)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.text = [str(i) for i in range(size)]

    def _pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; very large where there is none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], np.int64(1) << 40)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens together gives just that pair."""
        good = np.ones(len(x), bool)
        open_ = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        good[(self._pair_ranks(x, y) < (np.int64(1) << 40))] = False
        open_ = np.flatnonzero(good)
        x, y = x[open_], y[open_]
        while len(open_):
            bx, by = self.born[x], self.born[y]
            more = (bx >= 0) | (by >= 0)
            open_, x, y, bx, by = open_[more], x[more], y[more], bx[more], by[more]
            # the later merge is undone; of equal ones the right one came later
            right = by >= bx
            limit = np.where(right, by, bx)
            x = np.where(right, x, self.right[x])
            y = np.where(right, self.left[y], y)
            across = self._pair_ranks(x, y)
            # an equal merge happens at the leftmost place: that is the border if the right token was undone
            bad = np.where(right, across <= limit, across < limit)
            good[open_[bad]] = False
            open_, x, y = open_[~bad], x[~bad], y[~bad]
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: the ids, and each id's word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = _GAP.join([w.decode("latin-1") for w in words])
        flat = np.fromiter(chain.from_iterable(self.matcher.iter_long(text)), np.int64).reshape(-1, 2)
        return flat[:, 1], np.searchsorted(np.cumsum(size + 1), flat[:, 0], "right")

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        token = [self.base[b] for b in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        heap = [(rank[p], i, *p) for i in range(n - 1) if (p := (token[i], token[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if token[i] == x else n
            if j >= n or token[i] != x or token[j] != y:
                continue
            token[i], token[j] = made[x, y], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (token[i], token[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if (h := before[i]) >= 0 and (p := (token[h], token[i])) in rank:
                heapq.heappush(heap, (rank[p], h, *p))
        return [t for t in token if t >= 0]

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merging of many short words at once: a merge in each word a round."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        token = self.base_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        none = np.int64(1) << 40
        done_token, done_owner = [], []
        while len(token):
            rank = np.full(len(token), none)
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self._pair_ranks(token[:-1][same], token[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(token)]))
            over = least == none
            if over.any():
                done_token.append(token[over])
                done_owner.append(owner[over])
                token, owner, rank, least = token[~over], owner[~over], rank[~over], least[~over]
                if not len(token):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]  # the leftmost of each word
            token[at] = self.rank_made[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, owner = token[keep], owner[keep]
        token, owner = np.concatenate(done_token), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(words) + 1)).tolist()
        ids = token[order].tolist()
        return [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode() for w in words]
        flat, owner = self.propose(raw)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = inner[~self.compatible(key // self.size, key % self.size)[where]]
        cuts = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        ids = flat.tolist()
        out = [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        failed = np.unique(owner[bad]).tolist()
        short = [k for k in failed if len(raw[k]) <= SHORT]
        for k in failed:
            if len(raw[k]) > SHORT:
                out[k] = tuple(self.merge(raw[k]))
        if short:
            for k, ids in zip(short, self.merge_all([raw[k] for k in short]), strict=True):
                out[k] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special tokens' strings included."""
        parts, specials = [], []
        for text in texts:
            found = self.special.findall(text) if self.special else []
            pieces = self.special.split(text) if found else [text]
            parts.append([self.word.findall(p) for p in pieces])
            specials.append([(self.specials[s],) for s in found])
        known = self.cache
        words = set()
        for pieces in parts:
            for piece in pieces:
                words.update(piece)
        new = list(words.difference(known))
        local = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        keep = [w for w in new if len(w) <= CACHE_CHARS][: max(0, CACHE_WORDS - len(known))]
        known.update((w, local[w]) for w in keep)
        look = known if len(keep) == len(new) else {w: local[w] if w in local else known[w] for w in words}
        out = []
        for pieces, marks in zip(parts, specials, strict=True):
            if not marks:
                ids = chain.from_iterable(map(look.__getitem__, pieces[0]))
            else:
                runs = [[*map(look.__getitem__, pieces[0])]]
                for mark, piece in zip(marks, pieces[1:], strict=True):
                    runs.append([mark, *map(look.__getitem__, piece)])
                ids = chain.from_iterable(chain.from_iterable(runs))
            out.append(np.fromiter(ids, np.int32))
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@cache
def tokenizer(path: str) -> ByteBpe:
    """One instance a worker process."""
    return ByteBpe(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    """Replace column ``text`` by ``ids``; a bounded amount of text at a time."""
    bpe = tokenizer(path)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        begin = 0
        while begin < batch.num_rows:
            texts, size, end = [], 0, begin
            while end < batch.num_rows and (end == begin or size < CHUNK):
                texts.append(column[end].as_py() or "")
                size += len(texts[-1])
                end += 1
            coded = bpe.encode_batch(texts)
            off = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(c) for c in coded], out=off[1:])
            values = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(values))
            rest = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([lists if k == at else rest.column(k) for k in range(rest.num_columns)], [ids if k == at else n for k, n in enumerate(rest.schema.names)])
            begin = end
    bpe.cache.clear()  # words of this task; the worker lives on for other work


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with column ``text`` replaced by its token ids (``array<int>``).

    The result equals the tokenizers library's for the same file with
    ``add_special_tokens=False``.  Null and empty texts give an empty array, texts of any
    length are encoded whole, repeated rows alike; other columns pass through, but one that
    is already named ``ids`` is replaced.  No shuffle: each partition is encoded where it is.
    """
    if ids in docs.columns and ids != text:
        docs = docs.drop(ids)
    schema = ", ".join(f"`{ids}` array<int>" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda b: encode_batches(b, path, text, ids), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with column ``ids`` replaced by the text that they stand for; null gives null.

    Byte sequences that are not UTF-8 become U+FFFD, as in the tokenizers library.
    """
    if text in coded.columns and ids != text:
        coded = coded.drop(text)
    schema = ", ".join(f"`{text}` string" if f.name == ids else f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            at = b.schema.get_field_index(ids)
            texts = pa.array([None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else b.column(k) for k in range(b.num_columns)], [text if k == at else n for k, n in enumerate(b.schema.names)])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode, and digest both.

    The three steps run in one pass over Arrow batches, so ids do not travel to the JVM.
    Null texts count as empty, a null doc_id stays null, repeated rows give repeated rows.
    """

    def run(batches):
        bpe = tokenizer(path)
        for b in encode_batches(batches, path, "text", "ids"):
            n, coded, plain = [], [], []
            lists = b.column(1)
            off, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for i in range(b.num_rows):
                ids = values[off[i] : off[i + 1]].tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(bpe.text.__getitem__, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
