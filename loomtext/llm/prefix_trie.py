"""Operator 12: prefix trie of conversations, from sorted neighbours.

Conversations are range-sorted by their turns' digests, so every node of the trie is
a run of neighbours, and two neighbours part at the depth of their common prefix.
Each partition takes its neighbour edges in descending depth and merges components by
union-find: a merge at depth d creates the branching node at d, and the chain of nodes
below it, down to the component's last merge, is complete.  A component that a
partition's first or last conversation belongs to may go on next door, so it stays
open: what hangs off it at one depth is contracted to one item.  Sixteen neighbouring
partitions' items are merged in the same way, and so on until one forest is left.

What is summed below a node needs no second pass.  Each conversation owns (is the
smallest member of) the nodes from some depth on; with A the characters of the turns it
does not own, the saving of a node at depth k with n members is the sum of A over the
members other than the owner, less (n - 1) times the characters before depth k.

Turns are compared by 128 bits of SHA-256.  A conversation travels as its turns'
digests and sizes (20 bytes a turn, never the texts), which must fit in one row.

Defined cases: null role or text is empty; null turns come first, equal turns go by
role, then by digest of the text; rows with a null conv_id form one conversation, the
smallest, whose id is returned as null and is empty as a decimal; negative ids
have the base that SQL's remainder gives (toward zero); an empty table gives no rows;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, range_parts

DIGEST = 16
#: Forests merged by one task.
FAN = 16
#: Bytes of the sort key that the range sampler reads.
SAMPLED = 1024 * DIGEST
#: Ids of equal conversations in one row.
IDS = 1 << 16
#: Rows of a table that a join may broadcast.
BROADCAST = 200_000
NO_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()

_FIELDS = [("kind", pa.string()), ("part", pa.int32()), ("idx", pa.int64()), ("depth", pa.int64()),
           ("owner", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()),
           ("saved", pa.int64()), ("ends", pa.int64()), ("ends_sha256", pa.string()),
           ("node_key", pa.binary()), ("parent", pa.int64()), ("parent_key", pa.binary()),
           ("key", pa.binary()), ("w", pa.list_(pa.int64())), ("lcp", pa.int64()), ("ids", pa.string())]
_ARROW = pa.schema(_FIELDS)
_SQL = ("kind string, part int, idx long, depth long, owner long, n long, kids long, leaves long, saved long, "
        "ends long, ends_sha256 string, node_key binary, parent long, parent_key binary, key binary, "
        "w array<long>, lcp long, ids string")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): each conversation's first h turns from its base, then its
    own; ``key`` is its turns' digests end to end, ``sizes`` their code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text),
                                         "UTF-8"), 256), 1, 2 * DIGEST)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("d"),
                    F.char_length(text).alias("n"))
    own = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")) \
        .agg(F.sort_array(F.collect_list(turn)).alias("t")) \
        .select("conv_id", F.transform("t", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("t"))
    own = materialize(own, "turns")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("t", 1, 5).alias("head"))
    c = F.col("conv_id")
    h = F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % 6, F.lit(0)).cast("int")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<d:string,n:int>>"))
    rest = F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0)))
    seq = own.withColumn("base", c - c % 100).join(heads, "base", "left") \
        .select(F.coalesce(c, F.lit(NO_ID)).alias("conv_id"), F.concat(first, rest).alias("s"))
    return seq.select("conv_id", F.unhex(F.array_join("s.d", "")).alias("key"),
                      F.col("s.n").cast("array<long>").alias("sizes"))


def common_depth(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    # the first depth at which the prefixes differ
    return bisect_left(range(1, n + 1), True, key=lambda d: a[:d * DIGEST] != b[:d * DIGEST])


def key_at(key: bytes, depth: int) -> bytes:
    return hashlib.md5(key[:depth * DIGEST]).digest()


class Forest:
    """Components over a run of items, merged by union-find in descending depth.

    An item is a node at ``depth`` as far as it is known: members ``n``, the smallest
    ``owner``, ``saved`` (the sum of A over the others), children ``kids``, ``leaves`` below
    them, conversations that end there; ``key`` and ``w`` (characters up to each
    depth) reach at least to ``depth``.
    """

    def __init__(self, items: list[dict], edges: list[int], level: int):
        self.items, self.edges, self.level = items, edges, level
        self.up = list(range(len(items)))
        self.pending: list[list[dict]] = [[] for _ in items]
        self.nodes: list[dict] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def rise(self, i: int, depth: int) -> None:
        """Make component i a partial node at ``depth``: its chain of nodes below is complete."""
        x = self.items[i]
        bottom, owner, n = x["depth"], x["owner"], x["n"]
        if bottom <= depth:
            return
        leaves = x["leaves"] if x["kids"] else 1
        ask = x["ends"] and x["ends_sha256"] is None
        for child in self.pending[i]:
            child["parent"] = owner
        self.nodes += self.pending[i]
        above = None
        for k in range(bottom, depth, -1):
            at_bottom = k == bottom
            node = {"kind": "node", "depth": k, "owner": owner, "n": n, "leaves": leaves,
                    "kids": x["kids"] if at_bottom else 1,
                    "saved": x["saved"] - (n - 1) * int(x["w"][k - 1] if k else 0),
                    "ends_sha256": x["ends_sha256"] if at_bottom and x["ends"] else EMPTY,
                    "node_key": key_at(x["key"], k) if at_bottom and (ask or self.level) else None,
                    "parent": owner, "parent_key": None}
            if k == depth + 1:
                above = node
            else:
                self.nodes.append(node)
        if depth < 0:  # the root has no parent
            above["parent"] = None
            self.nodes.append(above)
            self.pending[i] = []
        else:
            self.pending[i] = [above]
        x |= {"depth": depth, "kids": 1, "leaves": leaves, "ends": 0, "ends_sha256": EMPTY}

    def join(self, i: int, j: int) -> None:
        """Merge two partial nodes of one depth; the greater owner loses all above it."""
        a, b = self.items[i], self.items[j]
        if len(self.pending[i]) < len(self.pending[j]):
            i, j = j, i
        self.up[j] = i
        self.pending[i] += self.pending[j]
        self.pending[j] = []
        ends = [x["ends_sha256"] for x in (a, b) if x["ends"]]
        self.items[i] = a | {
            "n": a["n"] + b["n"], "owner": min(a["owner"], b["owner"]),
            "saved": a["saved"] + b["saved"] + int(a["w"][a["depth"]]),
            "kids": a["kids"] + b["kids"], "leaves": a["leaves"] + b["leaves"], "ends": a["ends"] + b["ends"],
            "ends_sha256": EMPTY if not ends else ends[0] if len(ends) == 1 else None}

    def merge(self, whole: bool) -> None:
        """All edges in descending depth.  Unless ``whole``, the first and the last item are
        open, and so is each component once an edge ties it to an open one."""
        last = len(self.items) - 1
        is_open = [not whole and i in (0, last) for i in range(last + 1)]
        order = np.argsort(-np.asarray(self.edges, np.int64), kind="stable").tolist()
        at = 0
        while at < len(order):
            depth = self.edges[order[at]]
            stop = at
            while stop < len(order) and self.edges[order[stop]] == depth:
                stop += 1
            tied = []
            for e in order[at:stop]:
                i, j = self.find(e), self.find(e + 1)
                if is_open[i] or is_open[j]:
                    tied.append(e)
                    continue
                self.rise(i, depth)
                self.rise(j, depth)
                self.join(i, j)
            for e in tied:
                for i in (self.find(e), self.find(e + 1)):
                    if not is_open[i]:
                        self.rise(i, depth)
                        is_open[i] = True
            at = stop
        if whole and self.items:
            self.rise(self.find(0), -1)

    def contracted(self) -> list[dict]:
        """The open items in order, each with its edge to the next; what hangs off them
        is complete but for its parent, which is asked for by key."""
        out, seen = [], None
        for i in range(len(self.items)):
            root = self.find(i)
            if root == seen:
                out[-1]["lcp"] = self.edges[i] if i < len(self.edges) else None
                continue
            seen = root
            x = self.items[root]
            for child in self.pending[root]:
                self.nodes.append(child | {"parent": None, "parent_key": key_at(x["key"], x["depth"])})
            edge_item = i in (0, len(self.items) - 1)
            depth = x["depth"]
            out.append(x | {
                "kind": "item", "idx": len(out), "lcp": self.edges[i] if i < len(self.edges) else None,
                "key": x["key"] if edge_item else x["key"][:depth * DIGEST],
                "w": [int(v) for v in x["w"][:depth + 1]]})
        return out


def _record(rows: list[dict], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part if n == "part" else r.get(n) for r in rows], t) for n, t in _FIELDS], schema=_ARROW)


def _batches(rows: list[dict], part: int, size: int = 50_000):
    for i in range(0, len(rows), size):
        yield _record(rows[i:i + size], part)


def _runs(batches):
    """Items of equal conversations in the sorted partition, and their ids."""
    items, ids = [], []
    for batch in batches:
        for conv, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes"))):
            if items and items[-1]["key"] == key:
                ids[-1].append(conv)
                continue
            w = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)
            items.append({"key": key, "w": w, "depth": len(sizes), "owner": conv})
            ids.append([conv])
    for x, members in zip(items, ids):
        x |= {"n": len(members), "ends": len(members), "kids": 0, "leaves": 0, "ends_sha256": None,
              "saved": (len(members) - 1) * int(x["w"][-1])}
    return items, ids


def _decimals(ids) -> str:
    return ",".join("" if c == NO_ID else str(c) for c in ids)


def _grow(batches):
    """One sorted partition: its complete nodes, its contracted forest, and the ids of
    equal conversations at its edges."""
    part = TaskContext.get().partitionId()
    items, ids = _runs(batches)
    if not items:
        return
    rows = []
    for i, (x, members) in enumerate(zip(items, ids)):
        if 0 < i < len(items) - 1:
            x["ends_sha256"] = hashlib.sha256(_decimals(members).encode()).hexdigest()
        else:
            key = key_at(x["key"], x["depth"])
            rows += [{"kind": "ids", "node_key": key, "owner": members[k], "ids": _decimals(members[k:k + IDS])}
                     for k in range(0, len(members), IDS)]
    edges = [common_depth(a["key"], b["key"]) for a, b in zip(items, items[1:])]
    forest = Forest(items, edges, 0)
    forest.merge(False)
    yield from _batches(rows + forest.contracted(), part)
    yield from _batches(forest.nodes, part)


def _merge(whole: bool, level: int):
    """Neighbouring forests into one."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("idx", "ascending")]).to_pylist()
        edges = []
        for a, b in zip(rows, rows[1:]):
            edges.append(a["lcp"] if a["part"] == b["part"] else common_depth(a["key"], b["key"]))
        forest = Forest(rows, edges, level)
        forest.merge(whole)
        out = ([] if whole else forest.contracted()) + forest.nodes
        part = rows[0]["part"] // FAN
        return pa.Table.from_batches([_record(out, part)])
    return run


def _id_digests(batches):
    """SHA-256 of the ids of each key, streamed in their order."""
    key, state = None, None
    out = []
    for batch in batches:
        for k, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        out.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()),
                                      pa.array([h for _, h in out], pa.string())], names=["node_key", "found"])


def trie_nodes(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    spark = conversations.sparkSession
    ship_package(spark)
    seqs = materialize(rebuilt(conversations), "rebuilt")
    parts = partitions or range_parts(seqs)
    long = F.octet_length("key") > SAMPLED
    dealt = seqs.repartitionByRange(parts, F.substring("key", 1, SAMPLED), long,
                                    F.when(~long, F.col("conv_id"))) \
        .sortWithinPartitions("key", "conv_id")
    levels = [materialize(dealt.mapInArrow(_grow, _SQL), "forest-0")]
    while not (len(levels) > 1 and parts == 1):
        parts = -(-parts // FAN)
        items = levels[-1].where("kind = 'item'").withColumn("block", F.floor(F.col("part") / FAN))
        merged = items.groupBy("block").applyInArrow(
            _drop_block(_merge(parts == 1, len(levels))), _SQL)
        levels.append(materialize(merged, f"forest-{len(levels)}"))

    nodes = levels[0].where("kind = 'node'")
    later = levels[1]
    for level in levels[2:]:
        later = later.unionByName(level)
    later = later.where("kind = 'node'")
    nodes = nodes.unionByName(later)

    # ids of conversations at partition edges: at most two keys a partition
    ids = levels[0].where("kind = 'ids'").select("node_key", "owner", "ids") \
        .repartition("node_key").sortWithinPartitions("node_key", "owner") \
        .mapInArrow(_id_digests, "node_key binary, found string")
    nodes = nodes.join(F.broadcast(ids), "node_key", "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", "found")).drop("found")

    # parents that were open when their children were complete
    owners = later.where("node_key IS NOT NULL").select(F.col("node_key").alias("parent_key"),
                                                        F.col("owner").alias("asked"))
    if owners.count() <= BROADCAST:
        owners = F.broadcast(owners)
    nodes = nodes.join(owners, "parent_key", "left").withColumn("parent", F.coalesce("parent", "asked"))

    def shown(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    return nodes.select(
        shown("owner").alias("conv_id"), "depth", shown("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256")


def _drop_block(fn):
    def run(table: pa.Table) -> pa.Table:
        return fn(table.drop_columns(["block"]))
    return run
