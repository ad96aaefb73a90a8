"""The opN_ queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import formatted_digests
from .chunk_dedup import exact_groups
from .common import LOWER, UPPER, read_table
from .decontam import contamination
from .hilbert_pack import pack
from .markov_secrets import secrets
from .merkle_manifest import manifest
from .pfor import round_trip
from .prefix_trie import trie_nodes
from .quality_mil import quality
from .rendezvous import shard_documents
from .setsketch import near_duplicates
from .suffix_tree_lm import scores
from .weak_pii import personal_data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def _low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


#: CRC-32 of a blob's bytes, bit by bit, in DuckDB.
_CRC = """
  (SELECT CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
     [CAST('0x' || substr(hex(encode(coalesce(text, ''))), 2*i+1, 2) AS BIGINT)
      FOR i IN range(octet_length(encode(coalesce(text, ''))))]),
     lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT))
"""


def _score(shard: int) -> str:
    return (f"-ln((CAST('0x' || substr(md5(k || ':{shard}'), 1, 13) AS BIGINT)::DOUBLE + 0.5)"
            f" / 4503599627370496.0)")


_OP2 = f"""
WITH RECURSIVE crc_table(n, c, step) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1
  FROM crc_table WHERE step < 8),
t AS (SELECT list(c ORDER BY n) AS table_ FROM crc_table WHERE step = 8),
base AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
         CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         {_CRC} AS text_crc32
  FROM documents, t),
scored AS (SELECT *, [{", ".join(_score(i) for i in range(17))}] AS s FROM base),
placed AS (
  SELECT *, list_position(s[1:16], list_min(s[1:16])) - 1 AS shard,
         list_position(s, list_min(s)) - 1 AS grown_shard
  FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard
                          ORDER BY substr(md5(k), 1, 3), doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""


@register("op2_rendezvous_shards", _OP2)
def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by weighted rendezvous hashing (law: key)."""
    return shard_documents(read_table(spark, sf_dir, "documents"))


@register("op1_suffix_tree_lm")
def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text under a probabilistic suffix tree."""
    return scores(read_table(spark, sf_dir, "documents"))


@register("op3_weak_pii")
def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans, and those that weak supervision adds."""
    return personal_data(read_table(spark, sf_dir, "documents"))


@register("op5_markov_secrets")
def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: base spans, and runs that look random."""
    return secrets(read_table(spark, sf_dir, "documents"))


@register("op4_token_ids")
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as patched frame-of-reference blocks and read back."""
    return round_trip(read_table(spark, sf_dir, "documents"))


@register("op6_quality_mil")
def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by gated attention over its passages."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_OP7 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, ws[n : n + 9] AS w
  FROM bw, range(1, 100000) r(n) WHERE len(ws) > 0 AND n <= greatest(len(ws) - 9, 1)),
lens AS (SELECT DISTINCT len(w) AS l FROM win),
occ AS (
  SELECT d.doc_id, d.n AS s, d.l, win.item_id
  FROM (SELECT doc_id, n, l, ws[n : n + l - 1] AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS n FROM dw), lens
        WHERE n + l - 1 <= len(ws)) d JOIN win ON win.w = d.w),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM occ))
  GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@register("op7_decontaminate", _OP7)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every whole document."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op8_hilbert_pack")
def op8_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 along a Hilbert curve."""
    return pack(read_table(spark, sf_dir, "documents"))


_OP9 = f"""
WITH d AS (SELECT doc_id, {_low("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


@register("op9_exact_dedup", _OP9)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts over chunk recipes; of each group the largest doc_id stays."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


@register("op10_setsketch_near_dedup")
def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over two-word shingles, similarity 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


_ESC = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_OP11 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
  FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length({_ESC.format('role')}) + 1
           + length({_ESC.format('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@register("op11_chat_format", _OP11)
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted from typed parts, and read back from the output."""
    return formatted_digests(read_table(spark, sf_dir, "conversations"))


_OP12 = f"""
WITH RECURSIVE crc_table(n, c, step) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1
  FROM crc_table WHERE step < 8),
tab AS (SELECT list(c ORDER BY n) AS table_ FROM crc_table WHERE step = 8),
own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS s
  FROM conversations GROUP BY conv_id),
head AS (SELECT conv_id, s, {_CRC.replace("text, ''", "CAST(conv_id AS VARCHAR), ''")} % 6 AS h FROM own, tab),
seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1 : o.h], []), o.s[o.h + 1 :]) AS s
  FROM head o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
pre AS (
  SELECT conv_id, d, s[1 : d] AS p, len(s) AS l, CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS w
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT d, p, min(conv_id) AS o, count(*) AS n, max(w) AS w,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = l), '') AS ends
  FROM pre GROUP BY d, p),
spot AS (SELECT pre.conv_id, pre.d, node.o FROM pre JOIN node USING (d, p)),
linked AS (
  SELECT node.*, spot.o AS parent FROM node LEFT JOIN spot ON spot.conv_id = node.o AND spot.d = node.d - 1),
kids AS (SELECT parent AS o, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT linked.*, coalesce(n_children, 0) AS k FROM linked LEFT JOIN kids USING (o, d)),
sub AS (
  SELECT spot.o, spot.d, count(*) FILTER (v.k = 0) AS n_leaves, sum((v.n - 1) * v.w) AS saved
  FROM full_ v JOIN spot ON spot.conv_id = v.o AND spot.d <= v.d GROUP BY 1, 2)
SELECT o AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, n_leaves,
       saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_ JOIN sub USING (o, d)
"""


@register("op12_prefix_trie", _OP12)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, one row per node."""
    return trie_nodes(read_table(spark, sf_dir, "conversations"))


def _field(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(p: str, levels: int) -> str:
    """Levels ``{p}0`` (g, i, h) to ``{p}{levels}``, and at each what stands left and right."""
    out = []
    for k in range(levels):
        out.append(f"""{p}c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {p}{k}),
{p}l{k} AS (
  SELECT a.g, a.i, any_value(a.c) AS c,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {p}c{k} a JOIN {p}c{k} b ON a.g IS NOT DISTINCT FROM b.g AND a.i // 16 = b.i // 16 GROUP BY a.g, a.i),
{p}{k + 1} AS (
  SELECT g, i // 16 AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {p}c{k} GROUP BY g, i // 16)""")
    return ",\n".join(out)


def _climb_sql(p: str, start: str, end: str, levels: int) -> str:
    """Proof text q and folded node f of every row of ``start`` (g, i, q, f, ...), level by level."""
    out, last = [], start
    for k in range(levels):
        name = end if k == levels - 1 else f"{p}w{k}"
        out.append(f"""{name} AS (
  SELECT w.* REPLACE (w.i // 16 AS i, CASE WHEN x.c = 1 THEN w.q ELSE w.q || x.l || x.r END AS q,
                      CASE WHEN x.c = 1 THEN w.f ELSE sha256(x.l || w.f || x.r) END AS f)
  FROM {last} w JOIN {p}l{k} x ON w.g IS NOT DISTINCT FROM x.g AND w.i = x.i)""")
        last = name
    return ",\n".join(out)


_CRC_ID = _CRC.replace("text, ''", "CAST(doc_id AS VARCHAR), ''")
_OP13 = f"""
WITH RECURSIVE crc_table(n, c, step) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1
  FROM crc_table WHERE step < 8),
tab AS (SELECT list(c ORDER BY n) AS table_ FROM crc_table WHERE step = 8),
rows_ AS (
  SELECT doc_id, source AS g, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC_ID} % 5 = 0 THEN {_leaf(_low("text"))} END AS tampered
  FROM documents, tab),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows_),
n0 AS (SELECT g, i, leaf AS h FROM d),
{_tree_sql("n", 6)},
s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS name FROM n6),
{_tree_sql("s", 4)},
dw AS (SELECT g, i, '' AS q, coalesce(tampered, leaf) AS f, doc_id, leaf FROM d),
{_climb_sql("n", "dw", "at_subroot", 6)},
sw AS (SELECT 0 AS g, s0.i, q, f, doc_id, leaf, s0.h AS subroot
       FROM at_subroot JOIN s0 ON at_subroot.g IS NOT DISTINCT FROM s0.name),
{_climb_sql("s", "sw", "at_root", 4)}
SELECT doc_id, leaf, subroot, s4.h AS root, sha256(q) AS proof_sha256, f AS folded_root, f = s4.h AS verified
FROM at_root, s4
"""


@register("op13_merkle_manifest", _OP13)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with proofs checked against tampered texts."""
    return manifest(read_table(spark, sf_dir, "documents"))
