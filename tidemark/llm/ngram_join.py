"""N-gram Jaccard join: signature trees over blocks of documents that share a pigeonhole key.

A document's set holds its distinct word shingles. Documents of equal sets form one node. Two sets of sizes a and
b that link differ in at most d = (a + b) (100 - percent) / (100 + percent) shingles, so if the hash range is cut
into more than d parts, they agree on all of at least one part: every node's parts are its keys, cut by a scheme
for its size class (and for the class below, if it can link there). Parts without shingles agree everywhere, so
schemes have spare parts, and only a node with more empty parts than those emits keys for them. Nodes that share
keys, directly or through others, form a block; no link leaves a block, and blocks lose no link. (MinHash bands
can take the keys' place, where a low percentage asks for too many parts.)

Each block is joined with itself by a signature tree. Nodes of the tree hold the OR of their members' shingle
bitmaps, their range of sizes and the most shingles that bitmaps hide; the dual traversal drops a pair of tree
nodes when their sizes are too far apart or the largest possible overlap is too small, or when all their members
are in one component already. Surviving pairs are compared exactly. A block of more than CHUNK nodes is cut into
chunks: first each chunk alone, then one node of every component found, then all chunks against the nodes
outside the block's largest component, so no task holds more than two chunks and no links are lost. Components are
carried as labels through these steps, and only what the last one finds needs connecting over the cluster.

Results for odd input: null, empty and blank texts have no shingles, link with nothing and are their own
component; rows with equal ids are rows of their own; a null id stays null and never names a component unless all
its ids are null; an empty table gives no rows; very long texts are read whole; extra columns are ignored. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, give_back
from .components import components

CHUNK = 2_000
LEAF, FAN = 16, 8
RATIO = 1.3  # of a size class's bounds; at least 100 / percent
WORDS, WORD_BYTES = 300_000, 32 << 20  # words whose hashes a worker keeps, and their bytes
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct n-word shingles."""

    def __init__(self, n: int):
        self.n, self.known, self.held = n, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lower-cases A-Z, splits at ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            size = sum(map(len, new))
            if len(known) + len(new) > WORDS or self.held + size > WORD_BYTES:
                known.clear()
                new = set(words)
                self.held, size = 0, sum(map(len, new))
            self.held += size
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = mix(s + h[i : len(h) - n + 1 + i] + np.uint64(i))
        return np.unique(s)


class Keys:
    """Pigeonhole keys of a shingle set, for links at ``percent`` of the union."""

    def __init__(self, percent: int):
        if not 100 / RATIO <= percent <= 100:
            raise ValueError("percent out of range")
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 13 // 10)))

    def scheme(self, c: int) -> tuple[int, int]:
        """(parts, spare parts) of size class c."""
        low, high = self.low[c], self.low[c + 1] - 1
        d = (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        if d == 0:
            return 1, 0
        parts = d + 1
        for _ in range(4):
            spare = int(1.5 * parts * np.exp(-low / parts)) + 2
            parts = d + 1 + spare
        return parts, spare

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        c = bisect_right(self.low, len(s)) - 1
        out = [self._keys(s, c)]
        if c and len(s) * self.percent <= (self.low[c] - 1) * 100:
            out.append(self._keys(s, c - 1))
        return np.concatenate(out)

    def _keys(self, s: np.ndarray, c: int) -> np.ndarray:
        parts, spare = self.scheme(c)
        part = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        total = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), first)
        label = np.uint64(c << 40) + part[first].astype(np.uint64)
        keys = mix(total ^ mix(label))
        if parts - len(first) > spare:
            empty = np.setdiff1d(np.arange(parts), part[first]).astype(np.uint64)
            keys = np.concatenate([keys, mix(mix(np.uint64(c << 40) + empty + np.uint64(1 << 63)))])
        return keys


class Bands:
    """MinHash band keys of a shingle set: ROWS rows a band, and bands until a link at ``percent`` is missed with a chance below MISS.

    Their number does not grow with the set, where pigeonhole keys at low percentages do.
    """

    ROWS, MISS = 5, 1e-9

    def __init__(self, percent: int):
        self.bands = int(np.ceil(np.log(self.MISS) / np.log(1 - min(0.999, percent / 100) ** self.ROWS)))
        n = np.arange(2 * self.ROWS * self.bands, dtype=np.uint64) + np.uint64(1)
        self.a, self.b = mix(n[::2]) | np.uint64(1), mix(n[1::2])
        self.label = mix(np.arange(self.bands, dtype=np.uint64) + np.uint64(1 << 40))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 1024):
            least = np.minimum(least, ((s[at : at + 1024, None] ^ self.b) * self.a).min(0))
        rows = mix(least).reshape(self.bands, self.ROWS)
        out = self.label.copy()
        for i in range(self.ROWS):
            out = mix(out + rows[:, i])
        return out


def _bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of each set (about four bits a shingle of the largest), and the shingles that each bitmap hides."""
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(map(len, sets)) + 1)), 6, 15))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (flat & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros((len(sets), bits // 64), np.uint64)
    np.bitwise_or.at(out, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out, np.array([len(s) for s in sets]) - np.bitwise_count(out).sum(1).astype(np.int64)


class SignatureTree:
    """Tree over sets; level 0 holds the sets in order, each further level the nodes over FAN (first: LEAF) below."""

    def __init__(self, bitmaps: np.ndarray, hidden: np.ndarray, sizes: np.ndarray):
        self.levels = [(bitmaps, hidden, sizes, sizes)]
        self.fans = []
        while len(self.levels[-1][0]) > 1:
            b, h, lo, hi = self.levels[-1]
            at = np.arange(0, len(b), LEAF if not self.fans else FAN)
            self.fans.append(LEAF if not self.fans else FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.maximum.reduceat(h, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def below(self, level: int, node: int) -> range:
        fan = self.fans[level - 1]
        return range(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))


def join_block(sets: list[np.ndarray], groups: np.ndarray, percent: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect ``sets`` as all links would, given that sets of equal ``groups`` are connected already.

    With ``other`` (a flag for each set), only pairs with at least one flagged set are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    # neighbours in the tree should be alike: order by the least hashes, which similar sets share
    order = np.lexsort((sizes, [int(s[0]) for s in sets]))
    sets, sizes, groups = [sets[i] for i in order], sizes[order], groups[order]
    flagged = np.ones(n, bool) if other is None else other[order]
    bitmaps, hidden = _bitmaps(sets)
    tree = SignatureTree(bitmaps, hidden, sizes)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, g in enumerate(groups.tolist()):
        j = seen.setdefault(g, i)
        if j != i:
            parent[root(i)] = root(j)
    span = [1]
    for f in tree.fans:
        span.append(span[-1] * f)

    def one(level: int, node: int) -> int:
        """The component of all members, or -1."""
        a, b = node * span[level], min((node + 1) * span[level], n)
        r = root(a)
        return r if all(root(i) == r for i in range(a + 1, b)) else -1

    marks = [flagged]
    for f in tree.fans:
        marks.append(np.logical_or.reduceat(marks[-1], np.arange(0, len(marks[-1]), f)))
    links = []
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if not (marks[level][i] or marks[level][j]):
            continue
        if level == 0:
            a, b = root(i), root(j)
            if i == j or a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(a, b)] = min(a, b)
                links.append((int(order[i]), int(order[j])))
            continue
        if level <= 2 and (r := one(level, i)) >= 0 and (i == j or r == one(level, j)):
            continue
        left, right = tree.below(level, i), tree.below(level, j)
        b, h, lo, hi = tree.levels[level - 1]
        x, y = slice(left.start, left.stop), slice(right.start, right.stop)
        most = np.stack([np.bitwise_count(b[k] & b[y]).sum(1, dtype=np.int64) for k in left]) + np.minimum(h[x, None], h[None, y])
        least = -(-percent * (lo[x, None] + lo[None, y]) // (100 + percent))
        near = (most >= least) & (100 * hi[x, None] >= percent * lo[None, y]) & (100 * hi[None, y] >= percent * lo[x, None])
        pairs = [(level - 1, left[p], right[q]) for p, q in zip(*np.nonzero(near), strict=True) if i != j or left[p] <= right[q]]
        pairs.sort(key=lambda t: t[1] != t[2])  # a node with itself first: dense groups become one component early
        stack += reversed(pairs)
    return links


def _labels(members: DataFrame, sets: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(node, label) of every member (node) of the groups ``by``: the least node that its group's links reach."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        label = np.arange(len(node))
        if len(node) > 1:
            for i, j in join_block([np.frombuffer(b, np.uint64) for b in pdf["s"]], label.copy(), percent):
                label[label == label[j]] = label[i]
        least = pd.Series(node).groupby(label).transform("min")
        give_back()
        return pd.DataFrame({"node": node, "label": least.to_numpy()})

    return members.join(sets, "node").groupBy(*by).applyInPandas(run, "node long, label long")


def _links(members: DataFrame, sets: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links (u, v) between the components ``comp`` of members (node, comp, flag) in the groups ``by``, with a flagged node in each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["flag", "node"], ascending=[False, True]).drop_duplicates("node")
        comp = pdf["comp"].to_numpy()
        found = join_block([np.frombuffer(b, np.uint64) for b in pdf["s"]], comp, percent, pdf["flag"].to_numpy(bool)) if len(pdf) > 1 else []
        give_back()
        return pd.DataFrame({"u": comp[[i for i, _ in found]] if found else [], "v": comp[[j for _, j in found]] if found else []}, dtype="int64")

    return members.join(sets, "node").groupBy(*by).applyInPandas(run, "u long, v long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, keys: type = Keys) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key reachable by links, itself included).

    Two documents link when 100 * (shingles in both) >= ``percent`` * (shingles in either). Blocks come from ``keys``:
    Keys, which lose nothing, or Bands, which are fewer at low percentages and miss a link with a chance below 1e-9.
    """

    def start():
        shingle, key_of = Shingler(words), keys(percent)

        def make(texts):
            n, node, packed = [], [], []
            for t in texts:
                s = shingle(t)
                n.append(len(s))
                node.append(int(mix(np.add.reduce(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None)
                packed.append(key_of(s).view(np.int64).tobytes())
            return [n, node, packed]

        return make

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    rows = cut(add_columns(source, ["t"], {"n": "long", "node": "long", "keys": "binary"}, start, ["id"]))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))

    def unpack(packed):
        return [[np.frombuffer(b, np.int64) for b in packed]]

    postings = add_columns(nodes, ["keys"], {"key": "array<long>"}, lambda: unpack, ["node"]).select("node", F.explode("key").alias("key"))
    # a key's nodes are tied to the least of them
    least = postings.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("key", "v")
    near = postings.join(least, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    blocks = cut(components(near).withColumnRenamed("root", "block"))

    # the shingle sets of nodes in blocks, from one document each
    chosen = nodes.select("node", "id").join(blocks, "node").select("id").distinct()

    def rebuild():
        shingle = Shingler(words)

        def make(texts):
            found = [shingle(t) for t in texts]
            return [[int(mix(np.add.reduce(mix(s ^ np.uint64(0x2545F4914F6CDD1D)), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None for s in found], [s.tobytes() for s in found]]

        return make

    # a node's only ids may be null: those rows are few or none, and are all read again
    again = source.join(chosen, source["id"].eqNullSafe(chosen["id"]), "left_semi")
    sets = cut(add_columns(again, ["t"], {"node": "long", "s": "binary"}, rebuild, []).where("node IS NOT NULL").groupBy("node").agg(F.first("s").alias("s")))

    counts = blocks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = cut(blocks.join(counts, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    label = cut(_labels(placed.select("node", "block", "chunk"), sets, ["block", "chunk"], percent))
    large = cut(placed.where("chunks > 1").join(label, "node"))
    if not large.isEmpty():
        parts = F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("parts")
        heads = large.select("block", F.col("label").alias("node")).distinct()
        heads = heads.join(heads.groupBy("block").agg(parts), "block").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
        merged = cut(_labels(heads.select("node", "block", "part"), sets, ["block", "part"], percent).select(F.col("node").alias("label"), F.col("label").alias("comp")))
        state = cut(large.join(merged, "label").select("node", "block", "chunk", "chunks", "comp"))
        main = state.groupBy("block", "comp").agg(F.count("*").alias("c")).groupBy("block").agg(F.max(F.struct("c", "comp")).alias("m"))
        minor = state.join(main.select("block", F.col("m.comp").alias("main")), "block").where("comp <> main")
        per = minor.groupBy("block").agg(parts)
        minor = minor.join(per, "block").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        flagged = minor.select("node", "block", "comp", "part", every.alias("chunk"), F.lit(True).alias("flag"))
        plain = state.join(per, "block").select("node", "block", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", F.lit(False).alias("flag"))
        found = components(_links(flagged.unionByName(plain), sets, ["block", "chunk", "part"], percent)).withColumnRenamed("node", "comp")
        whole = state.join(found, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))
        label = label.join(whole, "node", "left").select("node", F.coalesce("root", "label").alias("root"))
    else:
        label = label.withColumnRenamed("label", "root")
    named = nodes.select("node", "id").join(label, "node")
    name = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = label.join(name, "root").select("node", "component_id")
    # one join for all documents, so that adaptive execution can split a set that very many of them share
    known = nodes.select("node", F.col("id").alias("_least")).join(linked, "node", "left").select("node", F.coalesce("component_id", "_least").alias("_name"))
    own = rows.select("id", "n", "node").join(known, "node", "left")
    return own.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_name", "id").alias("component_id"))
