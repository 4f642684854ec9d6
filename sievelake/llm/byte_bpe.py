"""Byte-level BPE encoding and decoding with a segment tree.

For each pre-token a segment tree over its byte positions holds the key ``rank * width + position`` of the
pair that starts there, so its root is the leftmost pair of minimum rank.  A merge changes three leaves (the
pair that is merged, its right part that dies, and the live neighbour on the left), each repaired along its
path to the root: a logarithmic number of steps a merge, so n bytes cost O(n log n) whatever they are.

Short pre-tokens are merged many at a time (numpy arrays, one tree a row); long ones one at a time with the
same tree in flat arrays.  Equal pre-tokens get equal ids, so those of short ones are kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map, texts, values

#: A pair without a merge. Above all keys: ranks stay under 2**31 and widths under 2**31.
NEVER = np.int64(1) << 62
#: Pre-tokens up to so many bytes are merged together in numpy rows.
WIDE = 64
#: So many numpy rows at a time, and so many known pre-tokens, of at most WIDE bytes, in a worker.
ROWS, KNOWN = 4096, 400_000
#: Bytes of text, and pre-tokens of one text, that a worker takes at a time: split, a text takes ten times its size.
SLICE, PIECE = 4 << 20, 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 of the token's bytes, blank, rank, on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class SegmentTreeBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("the ranks must have all 256 single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 if none (or a side is absent: below 0)."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def encode_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes (a power of two): one tree a row, all merged in step."""
        n, size = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        token = np.where(place < size[:, None], self.single[raw], -1)
        token = np.concatenate([token, np.full((n, 1), -1)], axis=1)  # place `width` stands for "no neighbour"
        after = np.broadcast_to(np.append(np.minimum(place + 1, width), width), (n, width + 1)).copy()
        after[:, :-1] = np.where(place + 1 < size[:, None], after[:, :-1], width)
        before = np.broadcast_to(np.append(place - 1, -1), (n, width + 1)).copy()
        before[before < 0] = width
        tree = np.full((n, 2 * width), NEVER)
        rank = self.pair_ranks(token[:, :-1], np.take_along_axis(token, after[:, :-1], 1))
        tree[:, width:] = np.where(rank >= 0, rank * width + place, NEVER)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while live.size:
            key = tree[live, 1]
            at, made = key % width, key // width
            dead = after[live, at]
            right = after[live, dead]
            left = before[live, at]
            token[live, at], token[live, dead] = made, -1
            after[live, at] = right
            before[live, right] = at  # for "no neighbour" a write that nothing reads
            ahead = self.pair_ranks(made, token[live, right])
            behind = self.pair_ranks(token[live, left], made)
            tree[live, width + dead] = NEVER
            tree[live, width + at] = np.where(ahead >= 0, ahead * width + at, NEVER)
            has = left < width
            tree[live[has], width + left[has]] = np.where(behind >= 0, behind * width + left, NEVER)[has]
            rows, node = np.concatenate([live, live, live[has]]), np.concatenate([at, dead, left[has]]) + width
            while node[0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < NEVER]
        found = token[:, :-1] >= 0
        ids = token[:, :-1][found].astype("<u4").tobytes()
        ends = (np.cumsum(found.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length."""
        n, never, ranks, tokens = len(word), int(NEVER), self.ranks, self.tokens
        width = 1 << max(1, (n - 1).bit_length())
        token = array("i", self.single[np.frombuffer(word, dtype=np.uint8)].astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        tree = array("q", [never]) * (2 * width)

        def key(i: int) -> int:
            j = after[i]
            rank = ranks.get(tokens[token[i]] + tokens[token[j]]) if j < n else None
            return never if rank is None else rank * width + i

        for i in range(n):
            tree[width + i] = key(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (root := tree[1]) < never:
            made, at = divmod(root, width)
            dead, left = after[at], before[at]
            right = after[dead]
            token[at], token[dead], after[at] = made, -1, right
            if right < n:
                before[right] = at
            tree[width + dead] = never
            tree[width + at] = key(at)
            changed = [at, dead]
            if left >= 0:
                tree[width + left] = key(left)
                changed.append(left)
            for leaf in changed:
                i = (width + leaf) >> 1
                while i:
                    best = min(tree[2 * i], tree[2 * i + 1])
                    if tree[i] == best:
                        break
                    tree[i] = best
                    i >>= 1
        ids = np.frombuffer(token, dtype=np.int32)
        return ids[ids >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers.

        A pre-token that is itself a token is that token, as in the public library.
        """
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > WIDE:
                out[i] = self.encode_long(word).astype("<u4").tobytes()
            elif word:
                by_width.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(i)
        for width, where in by_width.items():
            for start in range(0, len(where), ROWS):
                part = where[start : start + ROWS]
                for i, ids in zip(part, self.encode_rows([words[j] for j in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Known:
    """Ids of pre-tokens met lately: at most KNOWN of them, in two halves of which the older one goes when the newer is full."""

    def __init__(self, bpe: SegmentTreeBPE):
        self.bpe, self.new, self.old = bpe, {}, {}

    def of(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of the pre-tokens of each list, one after the other."""
        words = set().union(*lists)
        unknown = words.difference(self.new)
        if len(self.new) + len(unknown) > KNOWN // 2:
            self.old, self.new, unknown = self.new, {}, words
        fresh = []
        for w in unknown:
            ids = self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                self.new[w] = ids
        self.new.update(zip(fresh, self.bpe.encode_words([w.encode() for w in fresh])))
        out = [b"".join(map(self.new.__getitem__, x)) for x in lists]
        for w in fresh:
            if len(w) > WIDE:
                del self.new[w]
        return out


#: The encoder of this worker process, by its ranks, for its later tasks: one at a time.
HELD: dict[bytes, Known] = {}


def worker_table(ranks: bytes) -> Known:
    key = hashlib.sha256(ranks).digest()
    if key not in HELD:
        HELD.clear()
        HELD[key] = Known(SegmentTreeBPE(load_ranks(ranks)))
    return HELD[key]


def narrow_split(pattern: str, below: int = 0x250):
    """The pattern for Python's faster ``re``, right for texts whose code points are all under ``below``.

    ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S`` become explicit classes; None if the pattern has other escapes.
    """
    import regex

    members = {}
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        own = regex.compile(name)
        members[name] = "".join(re.escape(chr(c)) for c in range(below) if own.match(chr(c)))
    out, inside = [], False
    for part in re.findall(r"\\p\{L\}|\\p\{N\}|\\s|\\S|\\.|.", pattern, re.S):
        if part in members:
            out.append(members[part] if inside else f"[{members[part]}]")
        elif part == "\\S" and not inside:
            out.append(f"[^{members[chr(92) + 's']}]")
        elif part[0] == "\\":
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


class _Encode:
    """Work of one task: ids of each text of a slice, and what is asked for besides."""

    def __init__(self, ranks, pattern: str, id_col: str, text_col: str, keep: tuple[str, ...]):
        self.ranks, self.pattern, self.id_col, self.text_col, self.keep = ranks, pattern, id_col, text_col, keep

    def start(self) -> None:
        import regex

        self.known = worker_table(self.ranks.value)
        self.wide, self.narrow = regex.compile(self.pattern), narrow_split(self.pattern)
        self.other = re.compile("[^\x00-\u024f]").search

    def split(self, text: str) -> list[str]:
        return (self.wide if self.narrow is None or self.other(text) else self.narrow).findall(text)

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a very long text, some pre-tokens at a time."""
        found = (m[0] for m in (self.wide if self.narrow is None or self.other(text) else self.narrow).finditer(text))
        while part := list(islice(found, PIECE)):
            yield self.known.of([part])[0]

    def __call__(self, batch: pa.RecordBatch) -> dict:
        out, own = {"n_tokens": [], **{k: [] for k in self.keep}}, texts(batch, self.text_col)
        if len(own) == 1 and len(own[0]) > SLICE:
            found = [b"".join(self.pieces(own[0]))]
        else:
            found = self.known.of([self.split(t) for t in own])
        for ids in found:
            out["n_tokens"].append(len(ids) // 4)
            if "ids" in out:
                out["ids"].append(ids)
            if "ids_sha256" in out:
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                back = self.known.bpe.decode(ids)
                if "decoded" in out:
                    out["decoded"].append(back)
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
        return {self.id_col: values(batch, self.id_col), **out}


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode every text; one row out for each row in, no shuffle.

    ``keep`` names the columns wanted beside the id and ``n_tokens``: ``ids`` (binary, little-endian unsigned
    32-bit), ``ids_sha256``, ``decoded`` (the bytes that the ids stand for), ``decoded_sha256``.  The rank file
    is read by the driver and broadcast (its size is the vocabulary's, not the data's); the pattern cuts
    each text into pre-tokens that are merged separately.

    Null and empty texts have no ids; repeated rows come out repeated; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    kinds = {"ids": "binary", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", "n_tokens bigint", *(f"{k} {kinds[k]}" for k in keep)])
    return arrow_map(df.select(id_col, text_col), _Encode(ranks, pattern, id_col, text_col, tuple(keep)), schema, text_col, SLICE)
