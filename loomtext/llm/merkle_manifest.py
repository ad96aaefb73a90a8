"""Operator 13: Merkle manifest of a dataset, by checkpoint and recompute.

Leaves of a source, in order of doc_id, are hashed sixteen at a time until one node, the
subroot, remains; the subroots, in order of source, become the root in the same way.
Only every second level is stored, as a table with one row per aligned subtree (256
nodes of one stored level under their node of the next).  To extract proofs, the
strata are walked from the root down: each subtree's row gets the path above it,
regenerates its missing level from the stored nodes, hands the siblings to its members,
and keeps nothing.

Positions come from a range sort by (source, doc_id, leaf): a source that holds a third
of all rows is dealt over many tasks, and the positions of a source cut by a task's end
are put right by one number a task.  No row carries more than 256 nodes, texts are
read once and never shuffled.

Defined cases: null fields are ``-``; a null source is a source of its own, the first;
null doc_ids come first; rows of one doc_id go by their leaf; equal rows are leaves of
their own; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import lower_ascii, materialize, range_parts

ARITY = 16
#: Levels from one stored level to the next.
STRIDE = 2
RUN = ARITY ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Digest of one row's fields, as bytes."""
    return F.unhex(F.sha2(F.encode(F.concat(*[field(columns[n]) for n in FIELDS]), "UTF-8"), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(g, doc_id, hash, tampered): a leaf per row; ``tampered`` only where 5 divides
    the CRC-32 of the decimal doc_id."""
    cols = {n: F.col(n) for n in FIELDS}
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return docs.select(
        F.col("source").cast("string").alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(cols).alias("hash"),
        F.when(chosen, leaf_hash(cols | {"text": lower_ascii(F.col("text"))})).alias("tampered"))


def _count_up(batches):
    """Task number, and positions that restart with every group of the sorted rows."""
    pid, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        at = []
        for g in b.column("g").to_pylist():
            if last is None or last[0] != g:
                last, n = (g,), 0
            at.append(n)
            n += 1
        yield b.append_column("_pid", pa.array([pid] * len(at), pa.int32())) \
            .append_column("_at", pa.array(at, pa.int64()))


def numbered(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """With ``pos``, the row's place in its group ``g``.

    Only the first group of a task can have begun in an earlier one, so the table of
    what comes before has at most one row a task, and is broadcast.
    """
    parts = partitions or range_parts(rows)
    dealt = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _pid int, _at long"
    placed = materialize(dealt.mapInArrow(_count_up, schema), "placed")
    ends = placed.groupBy("_pid", "g").agg((F.max("_at") + 1).alias("n"))
    before = F.expr("sum(n) OVER (PARTITION BY g ORDER BY _pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    base = ends.withColumn("base", before).where("base > 0") \
        .select(F.col("_pid").alias("p"), F.col("g").alias("first"), "base")
    return placed.join(F.broadcast(base), (F.col("_pid") == F.col("p")) & F.col("g").eqNullSafe(F.col("first")),
                       "left") \
        .withColumn("pos", F.col("_at") + F.coalesce("base", F.lit(0))).drop("p", "first", "base", "_pid", "_at")


def above(nodes: list[str]) -> list[str]:
    return [sha(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]


def regenerate(nodes: list[str], entire: bool) -> list[list[str]]:
    """Levels of an aligned subtree from its stored nodes up to its top.  ``entire``: it is
    all of its tree, which ends as soon as one node is left."""
    levels = [nodes]
    for _ in range(STRIDE):
        if entire and len(levels[-1]) == 1:
            break
        levels.append(above(levels[-1]))
    return levels


def _tops(batches):
    for b in batches:
        full, alone = [], []
        for idx, members in zip(b.column("idx").to_pylist(), b.column("m").to_pylist()):
            nodes = [x["hash"].hex() for x in members]
            full.append(bytes.fromhex(regenerate(nodes, False)[-1][0]))
            own = members[0].get("alone") if idx == 0 and len(nodes) == 1 else None
            alone.append(own or bytes.fromhex(regenerate(nodes, True)[-1][0]))
        yield b.append_column("full", pa.array(full, pa.binary())) \
            .append_column("alone", pa.array(alone, pa.binary()))


def _stratum(nodes: DataFrame, name: str) -> DataFrame:
    """Aligned runs of 256 stored nodes, each with the node above: ``full`` as part of a
    larger tree, ``alone`` as all of its tree."""
    carried = [c for c in nodes.columns if c not in ("g", "pos")]
    rows = nodes.groupBy("g", F.floor(F.col("pos") / RUN).cast("long").alias("idx")) \
        .agg(F.sort_array(F.collect_list(F.struct((F.col("pos") % RUN).cast("int").alias("at"), *carried))).alias("m"))
    schema = (f"g {rows.schema['g'].dataType.simpleString()}, idx long, "
              f"m {rows.schema['m'].dataType.simpleString()}, full binary, alone binary")
    return materialize(rows.mapInArrow(_tops, schema), name)


def strata(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored levels of the tree of every group ``g``, from (g, pos, hash, ...) up; the last
    has one row a group, whose ``alone`` is the group's top."""
    out = [_stratum(nodes, f"{name}-0")]
    while not out[-1].where("idx > 0").isEmpty():
        up = out[-1].select("g", F.col("idx").alias("pos"), F.col("full").alias("hash"), "alone")
        out.append(_stratum(up, f"{name}-{len(out)}"))
    return out


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node's ancestors in their runs, bottom up."""
    out = []
    for nodes in levels[:-1]:
        start = at - at % ARITY
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + ARITY])))
        at //= ARITY
    return out


def _text(path) -> str:
    return "".join(f"{left}|{right};" for left, right in path)


def _path(text: str) -> list[list[str]]:
    return [p.split("|") for p in text.split(";")[:-1]]


def _subtrees(batches):
    """(position, member, siblings inside the subtree, row) of every member of every row."""
    for b in batches:
        names = b.schema.names
        for values in zip(*(b.column(n).to_pylist() for n in names)):
            row = dict(zip(names, values))
            nodes = [x["hash"].hex() for x in row["m"]]
            # a tree that ended below has one node here, and nothing to add
            ended = row["entire"] and len(nodes) == 1
            levels = [nodes] if ended else regenerate(nodes, row["entire"])
            yield row, [(x, _siblings(levels, x["at"])) for x in row["m"]], ended


def _hand_down(name: str | None):
    """Paths of a row's members: subtrees of the stratum below, or with ``name`` the
    trees whose tops are this tree's leaves."""
    def run(batches):
        for row, members, ended in _subtrees(batches):
            out = [(x[name] if name else row["g"], 0 if name else row["idx"] * RUN + x["at"],
                    _text(inside) + row["path"], True if name else ended, x["hash"] if name else row["top"])
                   for x, inside in members]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()))], names=_HANDED_NAMES)
    return run


_HANDED = "g string, idx long, path string, entire boolean, top binary"
_HANDED_NAMES = ["g", "idx", "path", "entire", "top"]


def _fold(leaf: str, path) -> str:
    for left, right in path:
        leaf = sha((left, leaf, right))
    return leaf


def _verified(root: str):
    """Proof and folded root of every document of a row."""
    def run(batches):
        for row, members, _ in _subtrees(batches):
            upper = _path(row["path"])
            out = []
            for x, inside in members:
                path = inside + upper
                leaf = x["hash"].hex()
                folded = _fold(x["tampered"].hex() if x["tampered"] else leaf, path)
                out.append((x["doc_id"], leaf, row["top"].hex(), root,
                            sha(left + right for left, right in path), folded, folded == root))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), *[pa.string()] * 5, pa.bool_()))], names=_PROVEN_NAMES)
    return run


_PROVEN = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")
_PROVEN_NAMES = [c.split()[0] for c in _PROVEN.split(", ")]


def _meet(stratum: DataFrame, handed: DataFrame) -> DataFrame:
    """Each row of a stratum with the path above it; both sides have a (g, idx) once."""
    down = handed.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), "path", "entire", "top")
    return stratum.select("g", "idx", "m").join(
        down, F.col("g").eqNullSafe(F.col("_g")) & (F.col("idx") == F.col("_idx"))).drop("_g", "_idx")


def manifest(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root folded from the (tampered) leaf, per row."""
    spark = docs.sparkSession
    ship_package(spark)
    # the row id lets the sorter split even a third of all rows being equal
    leaves = materialize(leaves_of(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(leaves, ["doc_id", "hash", "row"], partitions).drop("row")
    trees = strata(leaves, "stratum")
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("alone").alias("hash"))
    forest = strata(numbered(tops, ["name"], partitions), "sources")
    top = forest[-1].select("alone").first()
    root = top[0].hex() if top else ""

    handed = forest[-1].select("g", "idx", F.lit("").alias("path"), F.lit(True).alias("entire"),
                               F.lit(None).cast("binary").alias("top"))
    for stratum in reversed(forest[1:]):
        handed = _meet(stratum, handed).mapInArrow(_hand_down(None), _HANDED)
    handed = _meet(forest[0], handed).mapInArrow(_hand_down("name"), _HANDED)
    for stratum in reversed(trees[1:]):
        handed = _meet(stratum, handed).mapInArrow(_hand_down(None), _HANDED)
    return _meet(trees[0], handed).mapInArrow(_verified(root), _PROVEN)

