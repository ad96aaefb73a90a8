"""Tokenizer queries: BPE training, vocabulary, encode/decode, round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DEFAULT_SPECIALS, WORD_PATTERN, WORD_SPECIALS
from ..operators import bpe as B
from ..operators import codec as X
from ..operators import quality as Q
from ..session import cut_lineage
from ..sources.tables import read_table
from .catalog import register
from .q_corpus import DOC_LINES_SQL, doc_lines

# Registered line-BPE size: 256 bytes + 4 specials + 16 merges.
N_MERGES = 16
LINE_VOCAB = 256 + len(DEFAULT_SPECIALS) + N_MERGES
WORD_MERGES = 64

_MODELS: dict = {}


def _identity(spark, sf_dir) -> tuple:
    """The application and the files of documents, as they are now."""
    meta = read_table(spark, sf_dir, "documents", balance=False).select(
        F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h"))
    files = meta.distinct().agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    return (spark.sparkContext.applicationId, sf_dir, files)


def line_model(spark, sf_dir, n_merges: int = N_MERGES):
    """Train (once per application and state of the input) the line tokenizer.

    The model is a small driver-side object (bounded by the vocabulary size);
    keeping it avoids re-running the merge loop for every query that encodes.
    """
    key = ("line", _identity(spark, sf_dir), n_merges)
    if key not in _MODELS:
        _MODELS[key] = B.train_line_bpe(doc_lines(spark, sf_dir), ["doc_id", "line_no"],
                                        vocab_size=256 + len(DEFAULT_SPECIALS) + n_merges,
                                        min_freq=2)
    return _MODELS[key]


def word_model(spark, sf_dir, n_merges: int = WORD_MERGES):
    key = ("word", _identity(spark, sf_dir), n_merges)
    if key not in _MODELS:
        _MODELS[key] = B.train_word_bpe(doc_lines(spark, sf_dir), ["doc_id", "line_no"],
                                        vocab_size=256 + len(WORD_SPECIALS) + n_merges,
                                        min_freq=2, specials=WORD_SPECIALS)
    return _MODELS[key]


#: The size that the reference trains to.
VOCAB, MIN_FREQ = 32_000, 2
#: A least count that ends training before the vocabulary is full.
RARE = 64


def full_model(spark, sf_dir, mode: str, min_freq: int = MIN_FREQ):
    """The tokenizer of 32,000 tokens, trained once per application and state of the input."""
    key = (mode, _identity(spark, sf_dir), VOCAB, min_freq)
    if key not in _MODELS:
        train, specials = {"line": (B.train_line_bpe, DEFAULT_SPECIALS),
                           "word": (B.train_word_bpe, WORD_SPECIALS)}[mode]
        _MODELS[key] = train(doc_lines(spark, sf_dir), ["doc_id", "line_no"], vocab_size=VOCAB,
                             min_freq=min_freq, specials=specials)
    return _MODELS[key]


def bpe_oracle_sql(n_merges: int, lowercase: bool = False) -> str:
    """Unrolled DuckDB CTE: one pair count + top-1 + replace per merge."""
    text = "lower(line)" if lowercase else "line"
    parts = [f"lines AS ({DOC_LINES_SQL})",
             f"""s0 AS (
  SELECT '<' || array_to_string(regexp_extract_all(hex(encode(t)), '..'), '><') || '>' AS q,
         count(*) AS w, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS first
  FROM (SELECT {text} AS t, doc_id, line_no FROM lines WHERE length(line) > 0) GROUP BY t)"""]
    for k in range(n_merges):
        parts.append(f"""p{k} AS (
  SELECT t[i] AS a, t[i + 1] AS b, sum(w) AS n, min(struct_pack(f := first, pos := i)) AS o
  FROM (SELECT string_split(substr(q, 2, length(q) - 2), '><') AS t, w, first FROM s{k}) x,
       range(1, len(t)) r(i)
  GROUP BY 1, 2)""")
        parts.append(f"m{k} AS (SELECT {k} AS rank, a, b, n FROM p{k} ORDER BY n DESC, o LIMIT 1)")
        parts.append(f"""s{k + 1} AS (
  SELECT replace(q, '<' || a || '><' || b || '>', '<' || a || b || '>') AS q, w, first
  FROM s{k}, m{k})""")
    union = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(n_merges))
    return "WITH " + ",\n".join(parts) + f"\nSELECT CAST(rank AS INTEGER) AS rank, a, b, " \
        f"CAST(n AS BIGINT) AS n FROM ({union})"


BPE_SQL = bpe_oracle_sql(N_MERGES)


def encode_oracle_sql(passes: int, bos_eos: bool = True, source_sql: str = DOC_LINES_SQL) -> str:
    """DuckDB mirror of line-mode encoding: ``passes`` unrolled left-to-right
    passes of the merge-set rule (a position merges when its pair is in the
    set and its offset inside the run of mergeable positions is even; positions
    are renumbered every pass), then
    surface → id (bytes, or 260 + rank for merges)."""
    parts = [f"m AS ({BPE_SQL})",
             "ms AS (SELECT a || ',' || b AS k FROM m)",
             f"""t0 AS (
  SELECT doc_id, line_no, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok
  FROM (SELECT doc_id, line_no, regexp_extract_all(hex(encode(line)), '..') AS toks
        FROM ({source_sql}) WHERE length(line) > 0))"""]
    w = "PARTITION BY doc_id, line_no ORDER BY i"
    for k in range(passes):
        parts.append(f"""q{k} AS (
  SELECT doc_id, line_no, i, rn, tok, nxt,
         coalesce(nxt IS NOT NULL AND (tok || ',' || nxt) IN (SELECT k FROM ms), false) AS mg
  FROM (SELECT *, lead(tok) OVER ({w}) AS nxt, row_number() OVER ({w}) AS rn FROM t{k}))""")
        parts.append(f"""s{k} AS (
  SELECT *, mg AND ((rn - coalesce(max(CASE WHEN NOT mg THEN rn END) OVER (
            {w} ROWS UNBOUNDED PRECEDING), 0) - 1) % 2 = 0) AS pick
  FROM q{k})""")
        parts.append(f"""t{k + 1} AS (
  SELECT doc_id, line_no, i, CASE WHEN pick THEN tok || nxt ELSE tok END AS tok
  FROM (SELECT *, lag(pick) OVER ({w}) AS prevpick FROM s{k})
  WHERE NOT coalesce(prevpick, false))""")
    ids = f"""ids AS (
  SELECT t.doc_id, t.line_no, t.i,
         CASE WHEN length(t.tok) = 2 THEN CAST(('0x' || t.tok) AS INTEGER)
              ELSE CAST({256 + len(DEFAULT_SPECIALS)} + m.rank AS INTEGER) END AS id
  FROM t{passes} t LEFT JOIN m ON m.a || m.b = t.tok)"""
    parts.append(ids)
    body = "list(id ORDER BY i)"
    if bos_eos:
        body = f"list_concat([258], {body}, [259])"
    return "WITH " + ",\n".join(parts) + \
        f"\nSELECT doc_id, line_no, {body} AS ids FROM ids GROUP BY doc_id, line_no"


ENCODE_PASSES = N_MERGES + 4


@register("bpe_merges", oracle=BPE_SQL)
def q_bpe_merges(spark, sf_dir):
    """Line-BPE merges (rank, a, b, n) learned over all document lines."""
    return line_model(spark, sf_dir).merges_df(spark)


_SPECIAL_VALUES = ", ".join(f"('{s}', {256 + i}, 'special')" for i, s in enumerate(DEFAULT_SPECIALS))


@register("bpe_vocab", oracle=f"""
WITH m AS ({BPE_SQL})
SELECT upper(lpad(to_hex(r.range), 2, '0')) AS token, CAST(r.range AS INTEGER) AS id,
       'byte' AS kind FROM range(256) r
UNION ALL SELECT * FROM (VALUES {_SPECIAL_VALUES}) v(token, id, kind)
UNION ALL SELECT a || b, CAST({256 + len(DEFAULT_SPECIALS)} + rank AS INTEGER), 'merge' FROM m
""")
def q_bpe_vocab(spark, sf_dir):
    """The id-ordered vocabulary: bytes, specials, then merges."""
    return line_model(spark, sf_dir).vocab_df(spark)


@register("bpe_encode", oracle=encode_oracle_sql(ENCODE_PASSES))
def q_bpe_encode(spark, sf_dir):
    """Every document line encoded (line mode) with BOS/EOS."""
    model = line_model(spark, sf_dir)
    return X.encode(doc_lines(spark, sf_dir), model, "line", "ids", add_bos=True, add_eos=True) \
        .select("doc_id", "line_no", "ids")


@register("roundtrip_mismatches", oracle=f"""
SELECT d.lang, count(*) AS n_lines, CAST(0 AS BIGINT) AS mismatches
FROM ({DOC_LINES_SQL}) l JOIN documents d USING (doc_id)
WHERE length(l.line) > 0 GROUP BY d.lang
""")
def q_roundtrip(spark, sf_dir):
    """decode(encode(line)) == line over the whole corpus, per language."""
    model = line_model(spark, sf_dir)
    lines = doc_lines(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    checked = Q.roundtrip(lines, model, "line")
    # aggregate per document before the join: one row per doc_id meets `documents`,
    # so a document holding a large share of all lines is not a hot join key
    per_doc = checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("bad"))
    return per_doc.join(docs, "doc_id").groupBy("lang").agg(
        F.sum("n").cast("long").alias("n_lines"), F.sum("bad").cast("long").alias("mismatches"))


@register("inspect_tokens", oracle=f"""
WITH e AS ({encode_oracle_sql(ENCODE_PASSES, True,
                              "SELECT item_id AS doc_id, 0 AS line_no, text AS line FROM benchmark")}),
m AS ({BPE_SQL}),
lab AS (
  SELECT CAST(range AS INTEGER) AS id, '<0x' || lower(lpad(to_hex(range), 2, '0')) || '>' AS label
  FROM range(256)
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({256 + i}, '{t}')" for i, t in enumerate(DEFAULT_SPECIALS))}) v(id, label)
  UNION ALL SELECT CAST({256 + len(DEFAULT_SPECIALS)} + rank AS INTEGER),
                   array_to_string(list_transform(regexp_extract_all(a || b, '..'),
                                                  lambda h: '<0x' || lower(h) || '>'), '')
  FROM m),
p AS (SELECT e.doc_id, list(lab.label ORDER BY k) AS pieces
      FROM (SELECT doc_id, generate_subscripts(ids, 1) AS k, unnest(ids) AS id FROM e) x
      JOIN lab USING (id) JOIN e USING (doc_id) GROUP BY e.doc_id)
SELECT b.item_id, b.text, e.ids, p.pieces, b.text AS decoded
FROM benchmark b JOIN e ON e.doc_id = b.item_id JOIN p ON p.doc_id = b.item_id
""")
def q_inspect(spark, sf_dir):
    """L2: text, ids, pieces and decoded text for every benchmark item."""
    model = line_model(spark, sf_dir)
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    enc = X.encode(bench, model, "text", "ids", add_bos=True, add_eos=True)
    out = X.decode(X.pieces(enc, model, "ids", "pieces"), model, "ids", "decoded")
    return out.select("item_id", "text", "ids", "pieces", "decoded")


# DuckDB's regex engine has no lookahead, so the oracle tokenizes with the
# pattern minus `\s+(?!\S)` (whole whitespace runs) and then applies what the
# lookahead does: a run of two or more whitespace characters followed by a
# piece gives up its last character; a last ' ' joins the next piece, any
# other character stands alone.  (Not covered: a contraction right after such
# a run, and non-ASCII whitespace; none occur in the tables — equal on every
# line at sf0.001, sf0.01 and sf0.1.)
WORD_PRETOKENS_SQL = r"""WITH l AS (SELECT doc_id, line_no, line FROM ({lines}) WHERE length(line) > 0),
p AS (SELECT doc_id, line_no,
             regexp_extract_all(line, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+') AS w
      FROM l)
SELECT doc_id, line_no, flatten(list_transform(range(1, len(w) + 1), lambda i:
  CASE
    WHEN regexp_full_match(w[i], '\s+') AND i < len(w) AND length(w[i]) >= 2 THEN
      CASE WHEN right(w[i], 1) = ' ' THEN [left(w[i], length(w[i]) - 1)]
           ELSE [left(w[i], length(w[i]) - 1), right(w[i], 1)] END
    WHEN regexp_full_match(w[i], '\s+') THEN [w[i]]
    WHEN i > 1 AND regexp_full_match(w[i - 1], '\s+') AND length(w[i - 1]) >= 2
         AND right(w[i - 1], 1) = ' ' THEN [' ' || w[i]]
    ELSE [w[i]] END)) AS words
FROM p""".format(lines=DOC_LINES_SQL)


@register("word_pretokens", oracle=WORD_PRETOKENS_SQL)
def q_word_pretokens(spark, sf_dir):
    """Word pre-tokenization of every document line (Java regex, lookahead)."""
    lines = doc_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no",
                        F.regexp_extract_all("line", F.lit(WORD_PATTERN), 0).alias("words"))


def word_bpe_oracle_sql(n_merges: int) -> str:
    """Unrolled DuckDB CTE for word mode: distinct pre-tokens weighted by count,
    one pair count + top-1 (ties: smallest a, b) + replace per merge."""
    parts = [f"pw AS ({WORD_PRETOKENS_SQL})",
             """s0 AS (
  SELECT '<' || array_to_string(regexp_extract_all(hex(encode(t)), '..'), '><') || '>' AS q,
         count(*) AS w
  FROM (SELECT unnest(words) AS t FROM pw) WHERE length(t) > 0 GROUP BY t)"""]
    for k in range(n_merges):
        parts.append(f"""p{k} AS (
  SELECT t[i] AS a, t[i + 1] AS b, sum(w) AS n
  FROM (SELECT string_split(substr(q, 2, length(q) - 2), '><') AS t, w FROM s{k}) x,
       range(1, len(t)) r(i)
  GROUP BY 1, 2)""")
        parts.append(f"m{k} AS (SELECT {k} AS rank, a, b, n FROM p{k} ORDER BY n DESC, a, b LIMIT 1)")
        parts.append(f"""s{k + 1} AS (
  SELECT replace(q, '<' || a || '><' || b || '>', '<' || a || b || '>') AS q, w FROM s{k}, m{k})""")
    union = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(n_merges))
    return "WITH " + ",\n".join(parts) + f"\nSELECT CAST(rank AS INTEGER) AS rank, a, b, " \
        f"CAST(n AS BIGINT) AS n FROM ({union})"


@register("word_bpe_merges", oracle=word_bpe_oracle_sql(WORD_MERGES))
def q_word_bpe_merges(spark, sf_dir):
    """Word-mode merges (never crossing a word) over all document lines."""
    return word_model(spark, sf_dir).merges_df(spark)


def word_encode_oracle_sql(n_merges: int, passes: int) -> str:
    """DuckDB mirror of word-mode encoding: per pass, every word merges the
    non-overlapping left-to-right occurrences of its lowest-rank pair."""
    w = "PARTITION BY doc_id, line_no, wi ORDER BY i"
    parts = [f"m AS ({word_bpe_oracle_sql(n_merges)})",
             f"pw AS ({WORD_PRETOKENS_SQL})",
             """t0 AS (
  SELECT doc_id, line_no, wi, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok
  FROM (SELECT doc_id, line_no, wi, regexp_extract_all(hex(encode(word)), '..') AS toks
        FROM (SELECT doc_id, line_no, generate_subscripts(words, 1) AS wi, unnest(words) AS word
              FROM pw)))"""]
    for k in range(passes):
        parts.append(f"""q{k} AS (
  SELECT x.*, m.rank AS r FROM (
    SELECT *, lead(tok) OVER ({w}) AS nxt, row_number() OVER ({w}) AS rn FROM t{k}) x
  LEFT JOIN m ON m.a = x.tok AND m.b = x.nxt)""")
        parts.append(f"""c{k} AS (
  SELECT *, coalesce(r = min(r) OVER (PARTITION BY doc_id, line_no, wi), false) AS cand FROM q{k})""")
        parts.append(f"""s{k} AS (
  SELECT *, cand AND ((rn - coalesce(max(CASE WHEN NOT cand THEN rn END) OVER (
            {w} ROWS UNBOUNDED PRECEDING), 0) - 1) % 2 = 0) AS pick
  FROM c{k})""")
        parts.append(f"""t{k + 1} AS (
  SELECT doc_id, line_no, wi, i, CASE WHEN pick THEN tok || nxt ELSE tok END AS tok
  FROM (SELECT *, lag(pick) OVER ({w}) AS prevpick FROM s{k})
  WHERE NOT coalesce(prevpick, false))""")
    parts.append(f"""ids AS (
  SELECT t.doc_id, t.line_no, t.wi, t.i,
         CASE WHEN length(t.tok) = 2 THEN CAST(('0x' || t.tok) AS INTEGER)
              ELSE CAST({256 + len(WORD_SPECIALS)} + m.rank AS INTEGER) END AS id
  FROM t{passes} t LEFT JOIN m ON m.a || m.b = t.tok)""")
    return "WITH " + ",\n".join(parts) + \
        "\nSELECT doc_id, line_no, list(id ORDER BY wi, i) AS ids FROM ids GROUP BY doc_id, line_no"


@register("word_bpe_encode", oracle=word_encode_oracle_sql(WORD_MERGES, 24))
def q_word_bpe_encode(spark, sf_dir):
    """I4: rank-ordered word-mode encoding of every document line."""
    model = word_model(spark, sf_dir)
    return X.encode(doc_lines(spark, sf_dir), model, "line", "ids", keep_text=False).select("doc_id", "line_no", "ids")


@register("token_frequency", oracle=f"""
SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id
                               FROM ({encode_oracle_sql(ENCODE_PASSES, bos_eos=False)}))
GROUP BY id
""")
def q_token_frequency(spark, sf_dir):
    """D1 over BPE ids: how often each vocabulary id occurs in the encoded corpus."""
    model = line_model(spark, sf_dir)
    enc = X.encode(doc_lines(spark, sf_dir), model, "line", "ids", keep_text=False)
    return enc.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("id_range_check", oracle=f"""
SELECT d.lang, count(*) AS n_ids, max(e.id) AS max_id, CAST(0 AS BIGINT) AS n_out_of_range,
       CAST(sum(CASE WHEN e.id >= {LINE_VOCAB} OR e.id < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown
FROM (SELECT doc_id, unnest(ids) AS id
      FROM ({encode_oracle_sql(ENCODE_PASSES, bos_eos=False)})) e
JOIN documents d USING (doc_id) GROUP BY d.lang
""")
def q_id_range_check(spark, sf_dir):
    """Encoded ids fit uint32 and are all in the vocabulary (per language)."""
    from ..operators import quality as Qm
    model = line_model(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    enc = X.encode(doc_lines(spark, sf_dir), model, "line", "ids", keep_text=False)
    per_doc = Qm.id_range_report(enc, model.vocab_df(spark), "ids", ["doc_id"])
    return per_doc.join(docs, "doc_id").groupBy("lang").agg(
        F.sum("n_ids").alias("n_ids"), F.max("max_id").alias("max_id"),
        F.sum("n_out_of_range").alias("n_out_of_range"), F.sum("n_unknown").alias("n_unknown"))


@register("merge_pair_hits", oracle=f"""
WITH m AS ({BPE_SQL}),
lines AS ({DOC_LINES_SQL}),
hx AS (SELECT hex(encode(line)) AS h FROM lines WHERE length(line) > 0),
pos AS (SELECT h, unnest(range(0, length(h) // 2 - 1)) AS i FROM hx),
p AS (SELECT substr(h, 2 * i + 1, 2) AS a, substr(h, 2 * i + 3, 2) AS b, count(*) AS n
      FROM pos GROUP BY 1, 2)
SELECT p.a, p.b, p.n FROM p WHERE EXISTS (SELECT 1 FROM m WHERE m.a = p.a AND m.b = p.b)
""")
def q_merge_pair_hits(spark, sf_dir):
    """Raw byte pairs of the corpus that are themselves learned merges."""
    from ..operators import counts as Km
    pairs = Km.byte_pair_counts(doc_lines(spark, sf_dir))
    return X.merge_pairs_in_corpus(pairs, line_model(spark, sf_dir))


@register("bpe_vocab_reloaded", oracle=f"""
WITH m AS ({BPE_SQL})
SELECT upper(lpad(to_hex(r.range), 2, '0')) AS token, CAST(r.range AS INTEGER) AS id,
       'byte' AS kind FROM range(256) r
UNION ALL SELECT * FROM (VALUES {_SPECIAL_VALUES}) v(token, id, kind)
UNION ALL SELECT a || b, CAST({256 + len(DEFAULT_SPECIALS)} + rank AS INTEGER), 'merge' FROM m
""")
def q_bpe_vocab_reloaded(spark, sf_dir):
    """Save the tokenizer tables, load them back, return the loaded vocabulary."""
    import os

    from ..session import scratch_path
    from ..sources import tokenizer_store as store
    path = os.path.join(scratch_path(spark, "tokenizer"), "model")
    store.save_model(spark, line_model(spark, sf_dir), path)
    return store.load_model(spark, path).vocab_df(spark)



@register("sql_udf_roundtrip", oracle=f"""
SELECT d.lang, count(*) AS n_lines, CAST(0 AS BIGINT) AS mismatches
FROM ({DOC_LINES_SQL}) l JOIN documents d USING (doc_id)
WHERE length(l.line) > 0 GROUP BY d.lang
""")
def q_sql_udf_roundtrip(spark, sf_dir):
    """2.K: the tokenizer registered as SQL functions; the round trip written in SQL."""
    from .. import sql as lsql
    lsql.register(spark, line_model(spark, sf_dir))
    doc_lines(spark, sf_dir).createOrReplaceTempView("loomtext_lines")
    read_table(spark, sf_dir, "documents", ["doc_id", "lang"]).createOrReplaceTempView("loomtext_docs")
    return spark.sql("""
        WITH per_doc AS (
          SELECT doc_id, count(*) AS n,
                 sum(CASE WHEN bpe_decode(bpe_encode(line)) = line THEN 0 ELSE 1 END) AS bad
          FROM loomtext_lines GROUP BY doc_id)
        SELECT d.lang, CAST(sum(p.n) AS BIGINT) AS n_lines, CAST(sum(p.bad) AS BIGINT) AS mismatches
        FROM per_doc p JOIN loomtext_docs d ON p.doc_id = d.doc_id GROUP BY d.lang""")


@register("word_artifacts_reloaded",
          oracle=f"SELECT rank, a, b FROM ({word_bpe_oracle_sql(WORD_MERGES)})")
def q_word_artifacts_reloaded(spark, sf_dir):
    """Write the word tokenizer as vocab.json + merges.txt, read them back,
    return the reloaded merges in rank order (equal to ``word_bpe_merges``)."""
    import os

    from ..session import scratch_path
    from ..sources import tokenizer_store as store
    model = word_model(spark, sf_dir)
    d = scratch_path(spark, "word_artifacts")
    store.save_word_artifacts(spark, model, d)
    back = store.load_word_artifacts(spark, os.path.join(d, "vocab.json"), os.path.join(d, "merges.txt"))
    return spark.createDataFrame([(r, a, b) for r, (a, b, _) in enumerate(back.merges)],
                                 "rank int, a string, b string")


_WORD_SPECIAL_VALUES = ", ".join(f"('{s}', {256 + i}, 'special')" for i, s in enumerate(WORD_SPECIALS))


@register("word_vocab_reloaded", oracle=f"""
WITH m AS ({word_bpe_oracle_sql(WORD_MERGES)})
SELECT upper(lpad(to_hex(r.range), 2, '0')) AS token, CAST(r.range AS INTEGER) AS id,
       'byte' AS kind FROM range(256) r
UNION ALL SELECT * FROM (VALUES {_WORD_SPECIAL_VALUES}) v(token, id, kind)
UNION ALL SELECT a || b, CAST({256 + len(WORD_SPECIALS)} + rank AS INTEGER), 'merge' FROM m
""")
def q_word_vocab_reloaded(spark, sf_dir):
    """The word vocabulary with its 7 specials, reloaded from vocab.json and
    merges.txt without being told the specials."""
    import os

    from ..session import scratch_path
    from ..sources import tokenizer_store as store
    d = scratch_path(spark, "word_vocab")
    store.save_word_artifacts(spark, word_model(spark, sf_dir), d)
    return store.load_word_artifacts(spark, os.path.join(d, "vocab.json"),
                                     os.path.join(d, "merges.txt")).vocab_df(spark)


_LOOKUP_SQL = f"""
  SELECT DISTINCT substr(h, 2 * i + 1, 4) AS token
  FROM (SELECT h, unnest(range(0, length(h) // 2 - 1)) AS i
        FROM (SELECT hex(encode(line)) AS h FROM ({DOC_LINES_SQL}) WHERE length(line) > 0))
  UNION SELECT lang FROM documents UNION SELECT '<eos>'
"""


@register("token_to_id", oracle=f"""
WITH m AS ({BPE_SQL}),
v AS (SELECT a || b AS token, CAST({256 + len(DEFAULT_SPECIALS)} + rank AS INTEGER) AS id FROM m
      UNION ALL SELECT token, id FROM (VALUES {_SPECIAL_VALUES}) s(token, id, kind))
SELECT t.token, CASE WHEN v.id IS NOT NULL THEN [v.id]
       WHEN regexp_full_match(t.token, '([0-9A-F]{{2}})+') THEN
            list_transform(regexp_extract_all(t.token, '..'), lambda h: CAST('0x' || h AS INTEGER))
       ELSE [257] END AS id
FROM ({_LOOKUP_SQL}) t LEFT JOIN v ON v.token = t.token WHERE t.token IS NOT NULL
""")
def q_token_to_id(spark, sf_dir):
    """Surfaces of all adjacent byte pairs (merges or byte fallback), of the
    languages (unknown) and of a special, looked up in the line vocabulary."""
    from ..operators import counts as Km
    pairs = Km.byte_pair_counts(doc_lines(spark, sf_dir)).select(F.concat("a", "b").alias("token"))
    langs = read_table(spark, sf_dir, "documents", ["lang"]).select(F.col("lang").alias("token"))
    eos = spark.createDataFrame([("<eos>",)], "token string")
    tokens = pairs.unionByName(langs).unionByName(eos).where("token is not null").distinct()
    return X.token_to_id(tokens, line_model(spark, sf_dir)).select("token", "id")


@register("id_to_token", oracle=f"""
WITH m AS ({BPE_SQL}),
e AS ({encode_oracle_sql(ENCODE_PASSES)}),
v AS (SELECT upper(lpad(to_hex(r.range), 2, '0')) AS token, CAST(r.range AS INTEGER) AS id,
             'byte' AS kind FROM range(256) r
      UNION ALL SELECT * FROM (VALUES {_SPECIAL_VALUES}) s(token, id, kind)
      UNION ALL SELECT a || b, CAST({256 + len(DEFAULT_SPECIALS)} + rank AS INTEGER), 'merge' FROM m)
SELECT v.id, v.token, v.kind, count(*) AS n
FROM (SELECT unnest(ids) AS id FROM e) x JOIN v USING (id) GROUP BY ALL
""")
def q_id_to_token(spark, sf_dir):
    """The surface of every id that the encoded corpus (with BOS/EOS) uses."""
    model = line_model(spark, sf_dir)
    enc = X.encode(doc_lines(spark, sf_dir), model, "line", "ids", add_bos=True, add_eos=True)
    used = enc.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    used = cut_lineage(used)  # a row an id; read twice
    return X.id_to_token(used, model).select("id", "token", "kind", "n")


@register("sql_word_encode", oracle=word_encode_oracle_sql(WORD_MERGES, 24))
def q_sql_word_encode(spark, sf_dir):
    """2.K/I4: word-mode encoding called from SQL."""
    from .. import sql as lsql
    lsql.register(spark, word_model(spark, sf_dir), prefix="word_bpe")
    doc_lines(spark, sf_dir).createOrReplaceTempView("loomtext_word_lines")
    return spark.sql("SELECT doc_id, line_no, word_bpe_encode(line) AS ids FROM loomtext_word_lines")


@register("bpe_merges_lower", oracle=bpe_oracle_sql(8, lowercase=True))
def q_bpe_merges_lower(spark, sf_dir):
    """Line BPE on lower-cased lines (8 merges); ``lowercase`` is kept in meta."""
    key = ("line-lower", _identity(spark, sf_dir), 8)
    if key not in _MODELS:
        _MODELS[key] = B.train_line_bpe(doc_lines(spark, sf_dir), ["doc_id", "line_no"],
                                        vocab_size=256 + len(DEFAULT_SPECIALS) + 8, min_freq=2,
                                        lowercase=True)
    return _MODELS[key].merges_df(spark)


@register("bpe_merges_full")
def q_bpe_merges_full(spark, sf_dir):
    """Line-BPE merges up to a vocabulary of 32,000 (or until no pair occurs twice)."""
    m = full_model(spark, sf_dir, "line")
    return m.merges_df(spark).withColumn("stop_reason", F.lit(m.stop_reason))


@register("word_bpe_merges_full")
def q_word_bpe_merges_full(spark, sf_dir):
    """Word-BPE merges up to a vocabulary of 32,000, 7 specials, least count 2."""
    m = full_model(spark, sf_dir, "word")
    return m.merges_df(spark).withColumn("stop_reason", F.lit(m.stop_reason))


@register("bpe_merges_min_freq")
def q_bpe_merges_min_freq(spark, sf_dir):
    """Line-BPE merges until no pair occurs 64 times."""
    m = full_model(spark, sf_dir, "line", RARE)
    return m.merges_df(spark).withColumn("stop_reason", F.lit(m.stop_reason))


@register("word_bpe_merges_min_freq")
def q_word_bpe_merges_min_freq(spark, sf_dir):
    """Word-BPE merges until no pair occurs 64 times."""
    m = full_model(spark, sf_dir, "word", RARE)
    return m.merges_df(spark).withColumn("stop_reason", F.lit(m.stop_reason))


@register("bpe_encode_full")
def q_bpe_encode_full(spark, sf_dir):
    """Every line encoded by the line tokenizer of 32,000 tokens, with BOS and EOS."""
    enc = X.encode(doc_lines(spark, sf_dir), full_model(spark, sf_dir, "line"), "line", "ids",
                   add_bos=True, add_eos=True)
    return enc.where("length(line) > 0").select("doc_id", "line_no", "ids")


@register("word_bpe_encode_full")
def q_word_bpe_encode_full(spark, sf_dir):
    """I4: every line encoded by the word tokenizer of 32,000 tokens."""
    enc = X.encode(doc_lines(spark, sf_dir), full_model(spark, sf_dir, "word"), "line", "ids")
    return enc.where("length(line) > 0").select("doc_id", "line_no", "ids")


@register("bpe_roundtrip_full", oracle=f"""
SELECT doc_id, count(*) AS n_lines, CAST(sum(octet_length(encode(line))) AS BIGINT) AS n_bytes,
       sum(length(line))::BIGINT AS n_chars
FROM ({DOC_LINES_SQL}) WHERE length(line) > 0 GROUP BY doc_id
""")
def q_bpe_roundtrip_full(spark, sf_dir):
    """L1: lines, bytes and characters of what the tokenizer of 32,000 decodes; only lines
    that come back as they went in are counted."""
    model = full_model(spark, sf_dir, "line")
    lines = doc_lines(spark, sf_dir).where("length(line) > 0")
    back = X.decode(X.encode(lines, model, "line", "ids"), model, "ids", "back")
    return back.where("line = back").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("back")).cast("long").alias("n_bytes"),
        F.sum(F.char_length("back")).cast("long").alias("n_chars"))
