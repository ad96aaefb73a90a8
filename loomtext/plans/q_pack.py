"""Packing queries: split, shards (exact / fast), windows, (x, y), batch plan.

Token ids here are UTF-8 bytes (built-in expressions), so every stage has a
DuckDB mirror; the packers themselves are tokenizer-agnostic (BPE ids flow
through the same operators, see ``bpe_pack_shards``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.permute import rounds_sql
from ..functions.text import byte_ids
from ..operators import codec as X
from ..operators import pack as P
from ..operators import quality as Q
from .catalog import register
from .q_corpus import DOC_LINES_SQL, doc_lines

SHARD_TOKENS = 50_000
WINDOW = 256
#: The loader wraps around: one and a half epochs.
BATCH, ACCUM, EPOCHS, WARMUP, LR = 8, 4, 1.5, 10, 3.0e-4
SEED = 42

SPLIT_LINES_SQL = f"""
  SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, doc_id, line_no, line,
         octet_length(encode(line)) AS n
  FROM ({DOC_LINES_SQL}) WHERE length(line) > 0
"""
OFFSETS_SQL = f"""
  SELECT *, sum(n) OVER (PARTITION BY split ORDER BY doc_id, line_no
                         ROWS UNBOUNDED PRECEDING) AS c
  FROM ({SPLIT_LINES_SQL})
"""


def split_lines(spark, sf_dir):
    return Q.assign_split(doc_lines(spark, sf_dir), "doc_id", method="modulo", val_every=10)


def line_lengths(spark, sf_dir):
    """(split, n) of every non-empty line."""
    return split_lines(spark, sf_dir).select("split", F.octet_length("line").cast("long").alias("n")) \
        .where("n > 0")


def byte_offsets(spark, sf_dir, split=None):
    """Lines with byte ids and their place; of one split only, if given, from the start."""
    lines = split_lines(spark, sf_dir).select("split", "doc_id", "line_no", "line")
    if split is not None:
        lines = lines.where(F.col("split") == split)
    # byte ids are computed inside the range blocks (the sampler reads raw lines)
    return P.token_offsets(lines, ["doc_id", "line_no"], encode=lambda df: X.byte_ids_of(
        df, "line").select("split", "doc_id", "line_no", "ids"))


def length_offsets(spark, sf_dir):
    """Lines' lengths and places: no ids are built where only totals are read."""
    lines = split_lines(spark, sf_dir).select("split", "doc_id", "line_no", F.octet_length("line").alias("n"))
    return P.token_offsets(lines, ["doc_id", "line_no"], ids_col=None)


@register("split_assign", oracle="""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents
""")
def q_split_assign(spark, sf_dir):
    """L3: deterministic document split (modulo mode; hash mode in the operator)."""
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    return Q.assign_split(docs, "doc_id", method="modulo", val_every=10)


@register("split_leakage", oracle=f"""
SELECT line AS text, CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS n_val
FROM ({SPLIT_LINES_SQL}) GROUP BY line
HAVING sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) > 0
   AND sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) > 0
""")
def q_split_leakage(spark, sf_dir):
    """L4: lines that occur in both the train and the val split."""
    lines = split_lines(spark, sf_dir).withColumnRenamed("line", "text")
    return Q.leakage(lines, "text", "split")


SHARDS_EXACT_SQL = f"""
WITH RECURSIVE o AS ({OFFSETS_SQL}),
b(split, bound) AS (
  SELECT split, min(c) FROM o WHERE c >= {SHARD_TOKENS} GROUP BY split
  UNION ALL
  SELECT b.split, (SELECT min(o.c) FROM o WHERE o.split = b.split AND o.c >= b.bound + {SHARD_TOKENS})
  FROM b WHERE b.bound IS NOT NULL
),
sh AS (
  SELECT o.split, o.n, CAST((SELECT count(*) FROM b WHERE b.split = o.split AND b.bound < o.c)
                            AS INTEGER) AS shard_id
  FROM o
)
SELECT split, shard_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_lines,
       printf('%s_%05d', split, shard_id) AS name
FROM sh GROUP BY split, shard_id
"""


@register("shards_exact", oracle=SHARDS_EXACT_SQL)
def q_shards_exact(spark, sf_dir):
    """Exact buffered sharding (S = 50,000 tokens) of both splits."""
    sh = P.shards_exact(length_offsets(spark, sf_dir), SHARD_TOKENS)
    return P.shard_totals(sh)


@register("shards_fast", oracle=f"""
SELECT split, CAST(floor((c - n) / {SHARD_TOKENS}) AS INTEGER) AS shard_id,
       CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_lines,
       printf('%s_%05d', split, CAST(floor((c - n) / {SHARD_TOKENS}) AS INTEGER)) AS name
FROM ({OFFSETS_SQL}) GROUP BY 1, 2
""")
def q_shards_fast(spark, sf_dir):
    """E5 fast mode: shard = floor(tokens before the line / S)."""
    return P.shard_totals(P.shards_fast(length_offsets(spark, sf_dir), SHARD_TOKENS))


@register("token_totals", oracle=f"""
SELECT split, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_tokens
FROM ({SPLIT_LINES_SQL}) GROUP BY split
""")
def q_token_totals(spark, sf_dir):
    """D3: lines and tokens per split (byte tokens): lengths only, no order needed."""
    return line_lengths(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n").cast("long").alias("n_tokens"))


WINDOWS_SQL = f"""
  WITH o AS ({OFFSETS_SQL}),
  toks AS (
    SELECT split, c - n AS s,
           list_transform(regexp_extract_all(hex(encode(line)), '..'),
                          lambda h: CAST(('0x' || h) AS INTEGER)) AS ids
    FROM o
  ),
  t AS (SELECT split, s + i - 1 AS g, ids[i] AS id FROM toks, range(1, len(ids) + 1) r(i)),
  w AS (SELECT split, CAST(g // {WINDOW} AS BIGINT) AS window_id, list(id ORDER BY g) AS ids
        FROM t GROUP BY 1, 2)
  SELECT split, window_id, ids FROM w WHERE len(ids) = {WINDOW}
"""


@register("windows", oracle=WINDOWS_SQL)
def q_windows(spark, sf_dir):
    """Non-overlapping 256-token windows of each split; tail dropped."""
    return P.windows(byte_offsets(spark, sf_dir), WINDOW)


@register("next_token_xy", oracle=f"""
SELECT split, window_id, ids[1:{WINDOW - 1}] AS x, ids[2:{WINDOW}] AS y FROM ({WINDOWS_SQL})
""")
def q_next_token_xy(spark, sf_dir):
    """Inputs and next-token labels of every window (shifted once)."""
    return P.xy(P.windows(byte_offsets(spark, sf_dir), WINDOW)).select("split", "window_id", "x", "y")


_LR_SQL = f"""round(CASE WHEN step < {WARMUP} THEN {LR} * step / {WARMUP}
            ELSE {LR} * 0.5 * (1 + cos(pi() * (step - {WARMUP}) / greatest(1, steps - {WARMUP}))) END, 12)"""
_DRAWS_SQL = f"""
w AS (SELECT window_id FROM ({WINDOWS_SQL}) WHERE split = 'train'),
n AS (SELECT count(*) AS nw, CAST(ceil({EPOCHS} * count(*) / {BATCH * ACCUM}) AS BIGINT) AS steps FROM w),
d AS (SELECT unnest(range(steps * {BATCH * ACCUM})) AS d, nw, steps FROM n)"""


@register("batch_plan", oracle=f"""
WITH {_DRAWS_SQL}
SELECT d // {BATCH * ACCUM} AS step, CAST((d // {BATCH}) % {ACCUM} AS INTEGER) AS micro,
       CAST(d % {BATCH} AS INTEGER) AS slot, w.window_id, {_LR_SQL} AS lr
FROM (SELECT *, d // {BATCH * ACCUM} AS step FROM d) d JOIN w ON w.window_id = d.d % d.nw
""")
def q_batch_plan(spark, sf_dir):
    """One and a half epochs of 4 micro-steps x 8 windows over the train
    windows in their order; the loader starts over when they are used up."""
    return _plan(spark, sf_dir, None)


@register("batch_plan_shuffled", oracle=f"""
WITH RECURSIVE {_DRAWS_SQL},
side AS (SELECT *, CAST(ceil(sqrt(nw)) AS BIGINT) AS a, CAST(ceil(nw / ceil(sqrt(nw))) AS BIGINT) AS b FROM n),
walk AS (
  {rounds_sql("(d % nw)", "a", "b", SEED, "d // nw",
              "(SELECT d.d, d.nw, d.steps, side.a, side.b FROM d, side)", "d, nw, steps, a, b")}
  UNION ALL
  {rounds_sql("x_", "a", "b", SEED, "d // nw", "walk WHERE x_ >= nw", "d, nw, steps, a, b")})
SELECT step, CAST((d // {BATCH}) % {ACCUM} AS INTEGER) AS micro, CAST(d % {BATCH} AS INTEGER) AS slot,
       x_ AS window_id, {_LR_SQL} AS lr
FROM (SELECT *, d // {BATCH * ACCUM} AS step FROM walk WHERE x_ < nw)
""")
def q_batch_plan_shuffled(spark, sf_dir):
    """The same, each epoch in a seeded order of its own."""
    return _plan(spark, sf_dir, SEED)


def _plan(spark, sf_dir, seed):
    total = line_lengths(spark, sf_dir).where(F.col("split") == "train").agg(F.sum("n")).first()[0] or 0
    count = P.window_count(total, WINDOW)
    plan = P.batch_plan(None, BATCH, ACCUM, P.steps_of(count, BATCH, ACCUM, EPOCHS), WARMUP, LR,
                        n_windows=count, spark=spark, seed=seed)
    return plan.withColumn("lr", F.round("lr", 12))


def _bpe_pack_oracle() -> str:
    from .q_tokenizer import ENCODE_PASSES, encode_oracle_sql
    enc = encode_oracle_sql(ENCODE_PASSES, bos_eos=False)
    return f"""
WITH RECURSIVE e AS ({enc}),
o AS (
  SELECT *, sum(n) OVER (PARTITION BY split ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, doc_id, line_no,
               len(ids) AS n FROM e WHERE len(ids) > 0)),
b(split, bound) AS (
  SELECT split, min(c) FROM o WHERE c >= 20000 GROUP BY split
  UNION ALL
  SELECT b.split, (SELECT min(o.c) FROM o WHERE o.split = b.split AND o.c >= b.bound + 20000)
  FROM b WHERE b.bound IS NOT NULL),
sh AS (SELECT o.*, CAST((SELECT count(*) FROM b WHERE b.split = o.split AND b.bound < o.c)
                        AS INTEGER) AS shard_id FROM o)
SELECT split, shard_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_lines,
       CAST(0 AS BIGINT) AS first_pos
FROM sh GROUP BY split, shard_id
"""


@register("bpe_pack_shards", oracle=_bpe_pack_oracle())
def q_bpe_pack_shards(spark, sf_dir):
    """I8/A4/A5: encode both splits with the line tokenizer, pack exact shards of
    20,000 tokens, write them (parquet, split directories) and scan them back;
    returns per-shard totals from the written table."""
    import os

    from ..operators import codec as X
    from ..session import scratch_path
    from .q_tokenizer import line_model
    model = line_model(spark, sf_dir)
    lines = split_lines(spark, sf_dir).select("split", "doc_id", "line_no", "line")
    # encoding runs inside the range blocks (after the shuffle), not before the sampler
    off = P.token_offsets(lines, ["doc_id", "line_no"], encode=lambda df: X.encode(
        df, model, "line", "ids", keep_text=False))
    sh = P.shard_positions(P.shards_exact(off, 20_000))
    path = os.path.join(scratch_path(spark, "shards"), "shards")
    P.write_shards(sh.withColumn("n", F.size("ids")), path, ["doc_id", "line_no"])
    back = P.read_shards(spark, path)
    return back.groupBy("split", "shard_id").agg(
        F.sum(F.size("ids")).cast("long").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_lines"), F.min("pos").alias("first_pos"))


def _word_pack_oracle() -> str:
    from .q_tokenizer import WORD_MERGES, word_encode_oracle_sql
    return f"""
WITH RECURSIVE e AS ({word_encode_oracle_sql(WORD_MERGES, 24)}),
o AS (
  SELECT *, sum(n) OVER (PARTITION BY split ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, doc_id, line_no,
               len(ids) AS n FROM e WHERE len(ids) > 0)),
b(split, bound) AS (
  SELECT split, min(c) FROM o WHERE c >= 20000 GROUP BY split
  UNION ALL
  SELECT b.split, (SELECT min(o.c) FROM o WHERE o.split = b.split AND o.c >= b.bound + 20000)
  FROM b WHERE b.bound IS NOT NULL),
sh AS (SELECT o.*, CAST((SELECT count(*) FROM b WHERE b.split = o.split AND b.bound < o.c)
                        AS INTEGER) AS shard_id FROM o)
SELECT split, count(DISTINCT shard_id) AS n_shards, CAST(sum(n) AS BIGINT) AS n_tokens,
       count(*) AS n_lines
FROM sh WHERE split = 'val' GROUP BY split
"""


@register("word_pack_shards", oracle=_word_pack_oracle())
def q_word_pack_shards(spark, sf_dir):
    """I8/A4/A5/D3: the byte-level word tokenizer's ids in exact shards of 20,000
    tokens, written by split; the validation split scanned back (pruned by its
    directory): shards, tokens and lines."""
    import os

    from ..operators import codec as X
    from ..session import scratch_path
    from .q_tokenizer import word_model
    model = word_model(spark, sf_dir)
    lines = split_lines(spark, sf_dir).select("split", "doc_id", "line_no", "line")
    off = P.token_offsets(lines, ["doc_id", "line_no"], encode=lambda df: X.encode(
        df, model, "line", "ids", keep_text=False))
    path = os.path.join(scratch_path(spark, "word-shards"), "shards")
    P.write_shards(P.shards_exact(off, 20_000), path, ["doc_id", "line_no"])
    return P.read_shards(spark, path, split="val").groupBy("split").agg(
        F.countDistinct("shard_id").alias("n_shards"), F.sum(F.size("ids")).cast("long").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_lines"))


@register("windows_per_shard", oracle=f"""
WITH RECURSIVE o AS ({OFFSETS_SQL}),
b(split, bound) AS (
  SELECT split, min(c) FROM o WHERE c >= {SHARD_TOKENS} GROUP BY split
  UNION ALL
  SELECT b.split, (SELECT min(o.c) FROM o WHERE o.split = b.split AND o.c >= b.bound + {SHARD_TOKENS})
  FROM b WHERE b.bound IS NOT NULL
),
sh AS (
  SELECT o.*, CAST((SELECT count(*) FROM b WHERE b.split = o.split AND b.bound < o.c)
                   AS INTEGER) AS shard_id
  FROM o
),
ps AS (SELECT *, c - n - min(c - n) OVER (PARTITION BY split, shard_id) AS pos FROM sh),
toks AS (
  SELECT split, shard_id, pos,
         list_transform(regexp_extract_all(hex(encode(line)), '..'),
                        lambda h: CAST(('0x' || h) AS INTEGER)) AS ids
  FROM ps
),
t AS (SELECT split, shard_id, pos + i - 1 AS g, ids[i] AS id
      FROM toks, range(1, len(ids) + 1) r(i)),
w AS (SELECT split, shard_id, CAST(g // {WINDOW} AS BIGINT) AS window_id,
             list(id ORDER BY g) AS ids FROM t GROUP BY 1, 2, 3)
SELECT split, shard_id, window_id, ids FROM w WHERE len(ids) = {WINDOW}
""")
def q_windows_per_shard(spark, sf_dir):
    """E3 per_shard + shard positions: 256-token windows restarting at every exact shard."""
    sh = P.shard_positions(P.shards_exact(byte_offsets(spark, sf_dir), SHARD_TOKENS))
    return P.windows(sh, WINDOW, per_shard=True).select("split", "shard_id", "window_id", "ids")


@register("shards_listed", oracle=f"""
SELECT split, shard_id, n_tokens, n_lines FROM ({_bpe_pack_oracle()})
WHERE split = 'train' AND (shard_id IN (0, 2, 70) OR shard_id BETWEEN 4 AND 9)
""")
def q_shards_listed(spark, sf_dir):
    """A5: scan of listed train shards (0, 2, 70 and the range 4 to 9) of the written
    table; only their folders are opened."""
    import os

    from ..session import scratch_path
    from .q_tokenizer import line_model
    model = line_model(spark, sf_dir)
    lines = split_lines(spark, sf_dir).select("split", "doc_id", "line_no", "line")
    off = P.token_offsets(lines, ["doc_id", "line_no"], encode=lambda df: X.encode(
        df, model, "line", "ids", keep_text=False))
    path = os.path.join(scratch_path(spark, "shards"), "shards")
    P.write_shards(P.shard_positions(P.shards_exact(off, 20_000)), path, ["doc_id", "line_no"])
    listed = P.read_shards(spark, path, "train", shards=[0, 2, 70]) \
        .unionByName(P.read_shards(spark, path, "train", shards=range(4, 10)))
    return listed.groupBy("split", "shard_id").agg(
        F.sum(F.size("ids")).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_lines"))
