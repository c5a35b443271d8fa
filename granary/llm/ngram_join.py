"""N-gram Jaccard join with count vectors in an R-tree: documents whose sets of word shingles have a similarity of `percent` or more.

The method. A set's shingles are hashed into groups; the counts of the groups are the set's point. For two points the sum of the
coordinate minima bounds the overlap of the sets from above, and so does the sum of minima of a point and an R-tree
node's upper corner. Pairs that the bound leaves are verified exactly on the sets of 64-bit shingle hashes.

One R-tree over all points would be searched by each of them, so points are first routed. In an order common to all (that of the hashes), two
sets of n and m shingles can only reach the similarity if they share one of their first n - need(n) + 1 shingles. Every set is sent
to the places of its first shingles, a bucket holds the sets of one place, and a tree is built in each bucket.

1. Documents become (key, sizes, point, first shingles); equal sets share a 64-bit key and count once from here on.
2. First shingles are dealt out by hash; those of one set alone end here. Places with the same sets are one.
3. A set's shared places get its point. In a place with at most HOT sets an R-tree of coarse points finds the pairs within the bound, and the
   bound of the fine points (FINE groups a shingle) leaves hardly any that don't link; a spanning forest of them goes on.
4. Hotter places (common passages, large groups of near copies) are left out for a set that has enough other first shingles left: PREFIX_MORE
   spare ones make up for them. Sets that haven't ("heavy") show all their shingles to each other and are dealt out by the rarest,
   those of one heavy set alone first. Only a set of which four fifths are hot even so is joined untested: to the
   smallest set of like size in its place, as a member of a family of its own.
5. Components of these candidate links are verified, each in one task by a tree of its own, exactly; a component of
   more than BLOCK sets or BLOCK_SHINGLES shingles is dealt into blocks, each with the component's smallest set. What doesn't link to that set is then
   compared with all blocks.

Links join documents into components exactly as if all pairs had been compared; no set, partner or candidate is capped.

Null or empty texts and texts without words have no shingles and link with nothing, not even each other. Texts of fewer than
five words are one shingle. Repeated rows are documents with equal sets. A document with a null doc_id links like others but
names no component: where all of a component's ids are null, its component_id is. Only doc_id and text are read, so other columns may have any name.
Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WHITE, WordHasher, hashable, maybe_in, mix, parts, session, text_chunks, written
from granary.operators.graph import components

N_WORDS, PERCENT = 5, 80
HOT, PREFIX_MORE, LEAF, BLOCK, BLOCK_SHINGLES, APART = 512, 0.06, 32, 16_000, 4_000_000, 1_000_000
GROUP_OF, LEAST_GROUPS, MOST_GROUPS, FINE = 4, 32, 4096, 2
#: Bits of a place's name: the hash of its sets, that of its smallest one; the rest is its size.
AT, LEAD = 38, 20


# ---- sets ----

class Shingler:
    """The sorted distinct shingle hashes of each text of a column."""

    def __init__(self, n: int = N_WORDS):
        self.n, self.words = n, WordHasher(WHITE)
        self.odd = [mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(n)]

    def __call__(self, column: pa.Array):
        """(row, hashes) in order."""
        n = self.n
        with np.errstate(over="ignore"):
            for i, j, data, bounds in text_chunks(column):
                h, _, _, first = self.words(data, bounds)
                if len(h) >= n:
                    grams = np.zeros(len(h) - n + 1, np.uint64)
                    for k in range(n):
                        grams += h[k : len(h) - n + 1 + k] * self.odd[k]
                    grams = mix(grams)
                for d in range(j - i):
                    a, b = first[d], first[d + 1]
                    if b - a >= n:
                        yield i + d, np.unique(grams[a : b - n + 1])
                    elif b > a:
                        short = np.uint64(b - a)
                        for k in range(a, b):
                            short = short + h[k] * self.odd[k - a]
                        yield i + d, mix(np.array([short], np.uint64))
                    else:
                        yield i + d, np.zeros(0, np.uint64)


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of n and m with that similarity: percent * (n + m - x) <= 100 * x."""
    return -(-percent * (n + m) // (100 + percent))


def first_of(n: int, percent: int = PERCENT) -> int:
    """How many of its first shingles a set of n must show: one more than it may lack in common with a set that it can reach."""
    return n - -(-percent * n // 100) + 1


def groups_of(n: int) -> int:
    """Groups for a set of n: a power of two near n / GROUP_OF, so that counts stay small and the bound sharp."""
    return 1 << int(np.clip(n // GROUP_OF, LEAST_GROUPS, MOST_GROUPS) - 1).bit_length()


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts of the groups: a hash's group is its top bits."""
    g = groups_of(len(hashes))
    return np.bincount((hashes >> np.uint64(65 - g.bit_length())).astype(np.int64), minlength=g)


def folded(p: np.ndarray, g: int) -> np.ndarray:
    """The point with fewer groups: neighbours add up."""
    return p.reshape(g, -1).sum(1) if len(p) > g else p


class Fine:
    """A set's point with FINE groups a shingle or more, most of them empty: the sorted groups of its hashes."""

    def __init__(self, hashes: np.ndarray):
        self.bits = self.bits_of(len(hashes))
        self.groups = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def bits_of(n: int) -> int:
        """As many as the coarse point has, or more."""
        return max(LEAST_GROUPS - 1, FINE * n - 1).bit_length()

    def packed(self) -> bytes:
        step = np.diff(self.groups, prepend=0)
        wide = step.max(initial=0) > 255
        return (b"\1" if wide else b"\0") + zstandard.ZstdCompressor(level=1).compress(step.astype(np.uint32 if wide else np.uint8).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Fine:
        out = cls.__new__(cls)
        out.groups = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint32 if data[0] else np.uint8), dtype=np.int64)
        out.bits = cls.bits_of(len(out.groups))
        return out

    def coarse(self) -> np.ndarray:
        """The set's `point`."""
        g = groups_of(len(self.groups))
        shift = self.bits + 1 - g.bit_length()
        return np.bincount(self.groups >> shift, minlength=g)

    def _numbered(self, bits: int) -> np.ndarray:
        """Groups, each with a running number, so a count of c is c distinct values."""
        x = self.groups >> (self.bits - bits)
        begin, n = _runs(x)
        return (x << 20) + np.arange(len(x)) - np.repeat(begin, n)

    def bound(self, other: Fine) -> int:
        """The sum of the coordinate minima."""
        bits = min(self.bits, other.bits)
        return overlap(self._numbered(bits), other._numbered(bits))


def key_of(hashes: np.ndarray) -> int:
    """A set's key, always even: key + 1 is its name as a member of a hot place."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) & ~1


# ---- the tree ----

class Tree:
    """Points sorted by size and packed into leaves; a node's upper corner is the coordinate maximum of what it holds."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT):
        self.percent, self.sizes = percent, sizes
        g = min(len(p) for p in points)
        self.flat = np.stack([folded(p, g) for p in points]).astype(np.int32)
        self.levels = []  # from leaves up: upper corners, smallest and largest size
        corners, low, high = self.flat, sizes, sizes
        while len(corners) > 1:
            cut = np.arange(0, len(corners), LEAF)
            corners, low, high = np.maximum.reduceat(corners, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((corners, low, high))

    def _bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of coordinate minima of each row of a with each of b, a few rows at a time."""
        step = max(1, (1 << 20) // max(1, b.size))
        return np.concatenate([np.minimum(a[i : i + step, None, :], b[None]).sum(2) for i in range(0, len(a), step)])

    def _leaf_pairs(self) -> list[tuple[int, int]]:
        """Pairs of leaves that may hold partners, from the root's down, each leaf with itself first."""
        depth = len(self.levels) - 1
        pairs = np.zeros((1, 2), int)
        while depth > 0:
            depth -= 1
            corners, low, high = self.levels[depth]
            child = np.arange(LEAF)
            pairs = np.stack([np.repeat(pairs[:, 0, None] * LEAF + child, LEAF, axis=1).ravel(), np.tile(pairs[:, 1, None] * LEAF + child, (1, LEAF)).ravel()], 1)
            a, b = pairs[(pairs[:, 0] <= pairs[:, 1]) & (pairs[:, 1] < len(corners))].T
            near = 100 * high[a] >= self.percent * low[b]
            a, b = a[near], b[near]
            kept = [np.zeros((0, 2), int)]
            for i in range(0, len(a), 4096):
                bound = np.minimum(corners[a[i : i + 4096]], corners[b[i : i + 4096]]).sum(1)
                ok = (100 + self.percent) * bound >= self.percent * (low[a[i : i + 4096]] + low[b[i : i + 4096]])
                kept.append(np.stack([a[i : i + 4096][ok], b[i : i + 4096][ok]], 1))
            pairs = np.concatenate(kept)
        order = np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))
        return pairs[order].tolist()

    def pairs(self, joined):
        """Pairs (i, j), j < i, that the bound leaves, the most promising of a pair of leaves first. joined(rows) gives the components that rows are in by now: leaves of one component are passed over."""
        n = len(self.flat)
        for a, b in self._leaf_pairs() if n > 1 else []:
            x, y = np.arange(a * LEAF, min(n, a * LEAF + LEAF)), np.arange(b * LEAF, min(n, b * LEAF + LEAF))
            if len({*joined(x), *joined(y)}) < 2:
                continue
            bound = self._bound(self.flat[y], self.flat[x])
            total = self.sizes[y][:, None] + self.sizes[x][None]
            ok = (100 + self.percent) * bound >= self.percent * total
            ok &= (100 * np.minimum(self.sizes[y][:, None], self.sizes[x][None]) >= self.percent * np.maximum(self.sizes[y][:, None], self.sizes[x][None])) & (y[:, None] > x[None])
            i, j = np.nonzero(ok)
            best = np.argsort(-(bound[i, j] / total[i, j]), kind="stable")
            yield from zip(y[i[best]].tolist(), x[j[best]].tolist(), strict=True)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self, rows) -> set[int]:
        return {self.find(x) for x in rows.tolist()}

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[tuple[int, int]]]:
    """The root of each set and a spanning forest of the links; sets must be sorted by size. A pair that is already joined isn't verified."""
    union, forest = Union(len(sets)), []
    if len(sets) > 1:
        tree = Tree([point(s) for s in sets], np.array([len(s) for s in sets]), percent)
        for i, j in tree.pairs(union.roots):
            if union.find(i) != union.find(j) and overlap(sets[i], sets[j]) >= need(len(sets[i]), len(sets[j]), percent):
                union.join(i, j)
                forest.append((i, j))
    return [union.find(i) for i in range(len(sets))], forest


# ---- stages ----

def _rows(cols: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols.values()], list(cols))


def _parted(tokens: list[np.ndarray], owners: list[int], deal: int, wide: bool) -> dict:
    """The sets' tokens by part: (part, tokens, keys)."""
    t, o = np.concatenate(tokens), np.repeat(np.arange(len(owners)), [len(x) for x in tokens])
    if not wide:
        t = t >> np.uint64(16)
    part = (t % np.uint64(deal)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    t, o, part = t[order], o[order], part[order]
    out = {"part": [], "tokens": [], "keys": []}
    for b, m in zip(*(x.tolist() for x in _runs(part)), strict=True):
        out["part"].append(int(part[b]))
        out["tokens"].append(t[b : b + m].tobytes() if wide else _pack(t[b : b + m]))
        out["keys"].append(_members(o[b : b + m], owners))
    return {c: (v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()}


def row_key(docs: DataFrame) -> F.Column:
    """What finds a set's text again: rows of equal id and text are interchangeable, and an id may be null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _shown(docs: DataFrame, percent: int) -> DataFrame:
    """Rows of two kinds: a document (doc, row, n, key, point), and the first shingles of a batch's sets that go to one part (part, tokens, keys)."""
    deal = parts(docs.sparkSession)
    kinds = {"doc": pa.int64(), "row": pa.int64(), "n": pa.int64(), "key": pa.int64(), "point": pa.binary(), "part": pa.int32(), "tokens": pa.binary(), "keys": pa.binary()}

    def filled(cols: dict) -> pa.RecordBatch:
        size = len(next(iter(cols.values()))[0])
        return _rows({c: cols.get(c, ([None] * size, t)) for c, t in kinds.items()})

    def run(batches):
        shingles = Shingler()
        for batch in batches:
            at, n, key, points, tokens, owners, seen = [], [], [], [], [], [], set()
            for r, h in shingles(batch.column(1)):
                at.append(r)
                n.append(len(h))
                k = key_of(h) if len(h) else None
                key.append(k)
                if k is None or k in seen:
                    points.append(None)
                    continue
                seen.add(k)
                points.append(Fine(h).packed())
                tokens.append(h[: first_of(len(h), percent) + int(PREFIX_MORE * len(h))])
                owners.append(k)
            if at:
                took = pa.array(at, pa.int64())
                yield filled({"doc": (batch.column(0).take(took), pa.int64()), "row": (batch.column(2).take(took), pa.int64()), "n": (n, pa.int64()), "key": (key, pa.int64()), "point": (points, pa.binary())})
            if tokens:
                yield filled(_parted(tokens, owners, deal, wide=False))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("row")).mapInArrow(run, "doc long, row long, n long, key long, point binary, part int, tokens binary, keys binary")


def _all_shown(deal: int):
    def run(batches):
        """All shingles of a batch's sets by part: (part, tokens, keys)."""
        shingles = Shingler()
        for batch in batches:
            keys, tokens = batch.column(0).to_pylist(), {}
            for r, h in shingles(batch.column(1)):
                if keys[r] not in tokens:
                    tokens[keys[r]] = h
            if tokens:
                yield _rows(_parted(list(tokens.values()), list(tokens), deal, wide=True))

    return run


def _pack(t: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return (t >> np.uint64(16)).astype(np.uint32).tobytes() + (t & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(data, np.uint16, n, 4 * n)


def _members(owner: np.ndarray, keys: list[int]) -> bytes:
    """Owners as the keys that occur (their number first) and a short number for each."""
    own, at = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(own) < 65536 else np.uint32
    return np.array([len(own), np.dtype(kind).itemsize], np.int64).tobytes() + np.array([keys[x] for x in own], np.int64).tobytes() + at.astype(kind).tobytes()


def _keys(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    return np.frombuffer(data, np.int64, n, 16)[np.frombuffer(data, np.uint16 if width == 2 else np.uint32, -1, 16 + 8 * n)]


def _runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
    return begin, np.diff(np.append(begin, len(t)))


def _shared(deal: int, wide: bool = False):
    def run(batches):
        yield from _shared_places(batches, deal, wide)

    return run


def _shared_places(batches, deal: int, wide: bool):
    """The places of this task that several sets show, by part of the set: keys, names, and whether more than HOT show them. Places in the order of their names are rare ones first."""
    held = [(np.frombuffer(t, np.uint64) if wide else _unpack(t), _keys(k)) for batch in batches for t, k in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tokens", "keys")], strict=True)]
    if not held:
        return
    t, k = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    t, k = t[new], k[new]
    begin, n = _runs(t)
    of = np.repeat(n, n)
    # Cool places with the same sets are one: a place is named by the sum of its sets' mixed keys. The name's upper bits
    # are the place's size (its logarithm) and a hash of its smallest set, which says where the place is dealt to: places of one group of copies mostly meet in one part.
    hot = of > HOT
    with np.errstate(over="ignore"):
        name = np.repeat(mix(np.add.reduceat(mix(k.view(np.uint64)), begin)) if len(begin) else np.zeros(0, np.uint64), n)
        lead = np.repeat(mix(k[begin].view(np.uint64)), n)
    name[hot] = lead[hot] = mix(t[hot])
    name = (name >> np.uint64(64 - AT)) | (lead >> np.uint64(64 - LEAD) << np.uint64(AT)) | (np.ceil(np.log2(of)).astype(np.uint64) << np.uint64(AT + LEAD))
    k, name, of, hot = k[of > 1], name[of > 1], of[of > 1], hot[of > 1]
    part = (k.view(np.uint64) % np.uint64(deal)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    k, name, hot, part = k[order], name[order], hot[order], part[order]
    out = {"part": [], "keys": [], "names": [], "hot": []}
    for b, m in zip(*(x.tolist() for x in _runs(part)), strict=True):
        out["part"].append(int(part[b]))
        out["keys"].append(k[b : b + m].tobytes())
        out["names"].append(name[b : b + m].tobytes())
        out["hot"].append(np.packbits(hot[b : b + m]).tobytes())
    if out["part"]:
        yield _rows({c: (v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()})


def _gathered(batches):
    """One row for each set of this task: (key, n_cool, n_hot, cool, hot), its places by name, as often as it shows them."""
    held = [(np.frombuffer(k, np.int64), np.frombuffer(n, np.uint64), np.unpackbits(np.frombuffer(h, np.uint8))[: len(k) // 8].astype(bool)) for batch in batches for k, n, h in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("keys", "names", "hot")], strict=True)]
    if not held:
        return
    k, name, hot = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((name, hot, k))
    k, name, hot = k[order], name[order], hot[order]
    begin, n = _runs(k)
    for i in range(0, len(begin), 5000):
        spans = [(b, b + m) for b, m in zip(begin[i : i + 5000].tolist(), n[i : i + 5000].tolist(), strict=True)]
        cool, warm = [name[a:b][~hot[a:b]] for a, b in spans], [name[a:b][hot[a:b]] for a, b in spans]
        yield _rows({
            "key": (k[begin[i : i + 5000]], pa.int64()), "n_cool": ([len(x) for x in cool], pa.int32()), "n_hot": ([len(x) for x in warm], pa.int32()),
            "cool": ([x.tobytes() for x in cool], pa.binary()), "hot": ([x.tobytes() for x in warm], pa.binary()),
        })


GATHERED = "key long, n_cool int, n_hot int, cool binary, hot binary"


def _rarest(percent: int):
    def run(batches):
        """Of sets (key, n, cool, hot) with all their places those that they must show in the order of rarity: shingles of their own come first and meet nobody."""
        for batch in batches:
            rows = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "cool", "hot")], strict=True)
            out = {"key": [], "cool": [], "hot": []}
            for k, n, cool, hot in rows:
                c, h = np.frombuffer(cool, np.uint64), np.frombuffer(hot, np.uint64)
                left = first_of(n, percent) - (n - len(c) - len(h))
                if left > 0:
                    out["key"].append(k)
                    out["cool"].append(np.unique(c[:left]).tobytes())
                    out["hot"].append(np.unique(h[: max(0, left - len(c))]).tobytes())
            yield _rows({c: (v, pa.int64() if c == "key" else pa.binary()) for c, v in out.items()})

    return run


def _hot_dealt(deal: int):
    def run(batches):
        """The hot places of a batch's sets by part: (place, band, key), each set in its own band and the next."""
        for batch in batches:
            keys, bands, hot = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "band", "hot"))
            t = [np.frombuffer(x, np.uint64) for x in hot]
            if not t:
                continue
            owner = np.tile(np.repeat(np.arange(len(t)), [len(x) for x in t]), 2)
            t = np.tile(np.concatenate(t), 2)
            band = np.array(bands, np.int32)[owner] + (np.arange(len(t)) >= len(t) // 2).astype(np.int32)
            part = (t % np.uint64(deal)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            t, owner, band, part = t[order], owner[order], band[order], part[order]
            out = {c: [] for c in ("part", "places", "bands", "keys")}
            for b, m in zip(*(x.tolist() for x in _runs(part)), strict=True):
                out["part"].append(int(part[b]))
                out["places"].append(t[b : b + m].tobytes())
                out["bands"].append(band[b : b + m].tobytes())
                out["keys"].append(_members(owner[b : b + m], keys))
            yield _rows({c: (v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()})

    return run


def _hot_links(batches):
    """Every set of a hot place and band with the smallest of them; each pair once. Keys are made odd."""
    held = []
    for batch in batches:
        for t, b, k in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("places", "bands", "keys")], strict=True):
            held.append((np.frombuffer(t, np.uint64), np.frombuffer(b, np.int32), _keys(k)))
    if not held:
        return
    t, band, k = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((k, band, t))
    t, band, k = t[order], band[order], k[order]
    begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (band[1:] != band[:-1])]))
    lead = np.repeat(k[begin], np.diff(np.append(begin, len(t))))
    pairs = np.unique(np.stack([k, lead], 1)[k != lead], axis=0) | 1
    if len(pairs):
        yield _rows({"a": (pairs[:, 0], pa.int64()), "b": (pairs[:, 1], pa.int64())})


def _dealt(deal: int):
    def run(batches):
        """The places of a batch's sets, with their points, by part."""
        for batch in batches:
            keys, n, cool, points = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "cool", "point"))
            t = [np.unique(np.frombuffer(x, np.uint64)) for x in cool]
            if not t:
                continue
            owner = np.repeat(np.arange(len(t)), [len(x) for x in t])
            t = np.concatenate(t)
            part = ((t >> np.uint64(AT) & np.uint64((1 << LEAD) - 1)) % np.uint64(deal)).astype(np.int32)
            order = np.lexsort((owner, part))
            t, owner, part = t[order], owner[order], part[order]
            begin, size = _runs(part)
            out = {c: [] for c in ("part", "tokens", "at", "keys", "sizes", "lengths", "points")}
            for b, m in zip(begin.tolist(), size.tolist(), strict=True):
                own, at = np.unique(owner[b : b + m], return_inverse=True)
                out["part"].append(int(part[b]))
                out["tokens"].append(t[b : b + m].tobytes())
                out["at"].append(at.astype(np.int64).tobytes())
                out["keys"].append(np.array([keys[x] for x in own], np.int64).tobytes())
                out["sizes"].append(np.array([n[x] for x in own], np.int64).tobytes())
                out["points"].append(b"".join(points[x] for x in own))
                out["lengths"].append(np.array([len(points[x]) for x in own], np.int64).tobytes())
            yield _rows({c: (v, pa.int32() if c == "part" else pa.binary()) for c, v in out.items()})

    return run


DEALT = "part int, tokens binary, at binary, keys binary, sizes binary, lengths binary, points binary"


def _candidates(percent: int):
    def run(batches):
        """A tree for each place; a spanning forest of the pairs within the bound."""
        tokens, members, keys, sizes, points, known = [], [], [], [], [], {}
        for batch in batches:
            for t, at, ks, ns, ls, ps in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tokens", "at", "keys", "sizes", "lengths", "points")], strict=True):
                ks, ns, ls = (np.frombuffer(x, np.int64) for x in (ks, ns, ls))
                numbers, p = np.empty(len(ks), np.int64), 0
                for i, (k, n, m) in enumerate(zip(ks.tolist(), ns.tolist(), ls.tolist(), strict=True)):
                    if k not in known:
                        known[k] = len(keys)
                        keys.append(k)
                        sizes.append(n)
                        points.append(ps[p : p + m])
                    numbers[i], p = known[k], p + m
                tokens.append(np.frombuffer(t, np.uint64))
                members.append(numbers[np.frombuffer(at, np.int64)])
        if not tokens:
            return
        t, m, size = np.concatenate(tokens), np.concatenate(members), np.array(sizes)
        order = np.lexsort((m, size[m], t))
        t, m = t[order], m[order]
        union, forest, tried, apart = Union(len(keys)), [], set(), set()
        fine = [Fine.unpacked(p) for p in points]
        del points
        begin, count = _runs(t)
        for b, c in zip(begin.tolist(), count.tolist(), strict=True):
            own = m[b : b + c]
            if c < 2 or len({union.find(x) for x in own.tolist()}) < 2:
                continue
            if (same := own.tobytes()) in tried:
                continue
            tried.add(same)
            tree = Tree([fine[x].coarse() for x in own], size[own], percent)
            for i, j in tree.pairs(lambda rows, own=own: union.roots(own[rows])):
                x, y = int(own[i]), int(own[j])
                if union.find(x) == union.find(y) or (x, y) in apart:
                    continue
                if fine[x].bound(fine[y]) >= need(sizes[x], sizes[y], percent):
                    union.join(x, y)
                    forest.append((keys[x], keys[y]))
                elif len(apart) < APART:  # many pairs meet in several places
                    apart.add((x, y))
        if forest:
            a, b = zip(*forest, strict=True)
            yield _rows({"a": (list(a), pa.int64()), "b": (list(b), pa.int64())})

    return run


def _verified(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Exact components among the sets of each candidate component in a block: (a, b) with the smallest key b of a's component. A text that isn't its key's (an id with several texts) is passed over."""
        keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
        held: dict[int, dict[int, np.ndarray]] = {}
        for r, h in Shingler()(table.column("text")):
            if len(h) and key_of(h) == keys[r]:
                held.setdefault(roots[r], {})[keys[r]] = h
        a, b = [], []
        for sets in held.values():
            order = sorted(sets, key=lambda k: (len(sets[k]), k))
            root = linked([sets[k] for k in order], percent)[0]
            least: dict[int, int] = {}
            for k, r in zip(order, root, strict=True):
                least[r] = min(k, least.get(r, k))
            for k, r in zip(order, root, strict=True):
                if least[r] != k:
                    a.append(k)
                    b.append(least[r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, set_key (null without shingles), component_id (the smallest doc_id reachable by links), row_key (of id and text), first_row (the row_key of the component's first row)."""
    spark = session(docs.sparkSession)
    n_parts = parts(spark)
    shown = written(_shown(docs, percent), "shown")
    sets = shown.where("part is null").select("doc", "row", "n", "key", "point")
    places = shown.where("part is not null").select("part", "tokens", "keys")
    gathered = lambda x, wide: x.repartition(n_parts, "part").mapInArrow(_shared(n_parts, wide), "part int, keys binary, names binary, hot binary").repartition(n_parts, "part").mapInArrow(_gathered, GATHERED)

    # Sets that link share as many of the places they show as both have spare ones, plus one: a set that shares fewer has no partner.
    # A set is heavy if its hot places are more than it has spare ones: all that it shares with a partner may be hot.
    met = written(gathered(places, False), "places")
    points = maybe_in(sets.where("point is not null"), met, "key").groupBy("key").agg(F.min("n").alias("n"), F.min("row").alias("row"), F.first("point").alias("point"))
    met = points.join(met, "key").where(F.expr(f"n_cool + n_hot > floor({PREFIX_MORE}D * {percent} / 100 * n - 1e-9D)"))
    met = written(met.withColumn("heavy", F.expr(f"n_hot > floor({PREFIX_MORE}D * n)")).drop("hot"), "met")

    # Links between heavy sets: these show all their shingles to each other and are dealt out by the rarest of them.
    heavy = met.where("heavy").select("key", "row", "n")
    bodies = docs.select(row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    whole = maybe_in(bodies, heavy, "row").join(heavy, "row").select("key", "text").mapInArrow(_all_shown(n_parts), "part int, tokens binary, keys binary")
    rare = written(gathered(whole, True), "whole").join(heavy, "key").where(F.expr(f"100 * (n_cool + n_hot) >= {percent} * n")).select("key", "n", "cool", "hot")
    rare = written(rare.mapInArrow(_rarest(percent), "key long, cool binary, hot binary"), "rare")

    # Only sets of like size can link: a hot place is one for each band of sizes, and a set is in its own band and the next.
    band = F.floor(F.log("n") / F.lit(np.log(100 / percent).item()) - F.lit(1e-9)).cast("int")
    hot = rare.where("length(hot) > 0").join(heavy, "key").select("key", band.alias("band"), "hot")
    hot_links = hot.mapInArrow(_hot_dealt(n_parts), "part int, places binary, bands binary, keys binary").repartition(n_parts, "part").mapInArrow(_hot_links, "a long, b long")

    cool = met.select("key", "n", "point", "cool").join(rare.select("key", F.col("cool").alias("more")), "key", "left")
    cool = cool.select("key", F.concat("cool", F.coalesce("more", F.lit(b""))).alias("cool"), "n", "point").where("length(cool) > 0")
    dealt = cool.mapInArrow(_dealt(n_parts), DEALT).repartition(n_parts, "part")
    candidates = dealt.mapInArrow(_candidates(percent), "a long, b long").unionByName(hot_links).distinct()
    near = components(candidates)
    near = written(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()), "near")

    # One document of each set in question brings its text.
    of = near.select(F.expr("node & ~1L").alias("key"), "root").join(met.select("key", "row", "n"), "key")
    counts = of.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    of = written(of.join(counts, "root").drop("n"), "of")
    sums = of.agg(F.count("*").alias("n"), F.max("blocks").alias("most")).first()
    texts = maybe_in(bodies, of, "row").join(of, "row").select("key", "root", "blocks", "text")
    bins = max(n_parts, sums["n"] // 500)  # components of one block share a task's group
    own = F.when(F.col("blocks") == 1, F.array(-1 - F.pmod(F.xxhash64("root"), F.lit(bins)).cast("int")))
    own = own.when(F.col("key") == F.expr("root & ~1L"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    blocks = texts.withColumn("block", F.explode(own)).withColumn("unit", F.when(F.col("block") < 0, F.lit(0)).otherwise(F.col("root")))
    links = blocks.groupBy("unit", "block").applyInArrow(_verified(percent), "a long, b long")
    if (sums["most"] or 0) > 1:  # what doesn't reach its candidate component's first set meets all its blocks
        blocks = written(blocks, "blocks")
        links = written(blocks.groupBy("unit", "block").applyInArrow(_verified(percent), "a long, b long"), "links")
        big = blocks.where("blocks > 1")
        done = components(links)
        reached = done.unionByName(done.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "own")
        lead = big.select("root").distinct().join(reached, F.expr("root & ~1L") == F.col("node"), "left").select("root", F.coalesce("own", F.expr("root & ~1L")).alias("lead_own"))
        state = big.join(reached, big["key"] == reached["node"], "left").withColumn("own", F.coalesce("own", "key")).drop("node").join(lead, "root")
        strangers = state.where("own <> lead_own").select("key", "root", "blocks", "text").dropDuplicates().withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("unit", F.col("root"))
        touched = strangers.select("root").distinct()
        again = big.join(touched, "root", "left_semi").unionByName(strangers.select(*big.columns))
        links = links.unionByName(again.groupBy("unit", "block").applyInArrow(_verified(percent), "a long, b long"))
    settled = components(links)

    roots = sets.join(settled, sets["key"] == settled["node"], "left").select("doc", "row", "n", "key", F.coalesce("root", "key").alias("root"))
    first = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row")
    smallest = roots.where("root is not null").groupBy("root").agg(F.min("doc").alias("least"), F.min(first).alias("first"), F.count("*").alias("size")).where("size > 1")
    out = roots.join(smallest, "root", "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), F.coalesce("least", "doc").alias("component_id"),
        F.col("row").alias("row_key"), F.coalesce("first.row", "row").alias("first_row"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one only where no other has an id); of rows equal in id and text the smallest by its other columns. Rows without shingles all stay. Columns are as they were, whatever their names."""
    rows = join(docs, percent)
    gone = rows.where("row_key <> first_row").select(F.col("row_key").alias("key")).distinct()
    twice = rows.where("set_key is not null and row_key = first_row").groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = docs.select(row_key(docs).alias("key"), F.struct("*").alias("row")).join(gone, "key", "left_anti")
    pick = F.min("row") if len(hashable(docs)) == len(docs.columns) else F.first("row")
    once = left.join(twice, "key", "left_semi").groupBy("key").agg(pick.alias("row"))
    return left.join(twice, "key", "left_anti").select("row.*").unionByName(once.select("row.*"))
