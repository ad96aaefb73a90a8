"""Corpus-level queries: assembly, cleaning, byte and pair statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import counts as K
from ..session import cut_lineage
from ..sources.tables import read_table
from .catalog import register

# DuckDB helpers shared by oracles: LF-split lines with their numbers.
DOC_LINES_SQL = """
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, parts[n] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
       range(1, len(parts) + 1) r(n)
"""


def doc_lines(spark, sf_dir, lowercase: bool = False):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return C.split_lines(docs, ["doc_id"], lowercase=lowercase)


def flat_corpus(spark, sf_dir):
    docs = C.documents_corpus(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    conv = C.conversations_corpus(
        read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]))
    return C.flatten_corpus(C.ordered_union(docs, conv))


FLAT_CORPUS_SQL = """
  SELECT 0 AS src_ord, 'documents' AS source, doc_id, CAST(0 AS BIGINT) AS part,
         replace(text, chr(10), ' ') AS text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, 'conversations', conv_id, turn, replace(text, chr(10), ' ')
  FROM conversations WHERE text IS NOT NULL
"""


@register("pair_counts", oracle=f"""
WITH lines AS ({DOC_LINES_SQL}),
hx AS (SELECT hex(encode(line)) AS h FROM lines WHERE length(line) > 0),
pos AS (SELECT h, unnest(range(0, length(h) // 2 - 1)) AS i FROM hx)
SELECT substr(h, 2 * i + 1, 2) AS a, substr(h, 2 * i + 3, 2) AS b, count(*) AS n
FROM pos GROUP BY 1, 2
""")
def q_pair_counts(spark, sf_dir):
    """Flagship: adjacent UTF-8 byte-pair counts over every line of documents."""
    return K.byte_pair_counts(doc_lines(spark, sf_dir))


@register("top_pair", oracle=f"""
WITH lines AS ({DOC_LINES_SQL}),
hx AS (SELECT doc_id, line_no, hex(encode(line)) AS h FROM lines WHERE length(line) > 0),
pos AS (SELECT doc_id, line_no, h, unnest(range(0, length(h) // 2 - 1)) AS i FROM hx),
pairs AS (
  SELECT substr(h, 2 * i + 1, 2) AS a, substr(h, 2 * i + 3, 2) AS b, count(*) AS n,
         min(struct_pack(doc_id := doc_id, line_no := line_no, i := i)) AS first
  FROM pos GROUP BY 1, 2)
SELECT a, b, n, first.doc_id AS first_doc, first.line_no AS first_line,
       CAST(first.i AS INTEGER) AS first_pos
FROM pairs ORDER BY n DESC, first LIMIT 1
""")
def q_top_pair(spark, sf_dir):
    """the most frequent adjacent byte pair, ties to the first seen."""
    top = K.top_byte_pair(doc_lines(spark, sf_dir))
    return top.select("a", "b", "n", F.col("doc_id").alias("first_doc"),
                      F.col("line_no").cast("int").alias("first_line"),
                      F.col("pos").cast("int").alias("first_pos"))


@register("byte_freq", oracle="""
SELECT tok AS token, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS tok FROM documents)
GROUP BY 1
""")
def q_byte_freq(spark, sf_dir):
    """How often each byte occurs in documents."""
    return K.byte_counts(read_table(spark, sf_dir, "documents", ["text"]), "text")


@register("corpus_flatten", oracle=FLAT_CORPUS_SQL)
def q_corpus_flatten(spark, sf_dir):
    """B2/G1: documents and conversations in order, one flattened line each."""
    return flat_corpus(spark, sf_dir).select("src_ord", "source", "doc_id", "part", "text")


@register("source_counts", oracle=f"""
SELECT source, count(*) AS n_rows, sum(octet_length(encode(text))) AS n_bytes
FROM ({FLAT_CORPUS_SQL}) GROUP BY source
""")
def q_source_counts(spark, sf_dir):
    """Rows and bytes of each source."""
    return K.source_counts(flat_corpus(spark, sf_dir))


CLEAN_SQL = f"""
  SELECT arg_min(src_ord, (src_ord, doc_id, part)) AS src_ord,
         arg_min(doc_id, (src_ord, doc_id, part)) AS doc_id,
         arg_min(part, (src_ord, doc_id, part)) AS part, text
  FROM (SELECT src_ord, doc_id, part,
               trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS text
        FROM ({FLAT_CORPUS_SQL}))
  WHERE length(text) > 0
  GROUP BY text
"""


@register("clean_corpus", oracle=CLEAN_SQL)
def q_clean_corpus(spark, sf_dir):
    """White space collapsed, empty and repeated texts dropped, first one kept."""
    return C.clean_corpus(flat_corpus(spark, sf_dir))


@register("byte_budget", oracle=f"""
SELECT src_ord, doc_id, part, text FROM (
  SELECT *, sum(octet_length(encode(text)) + 1) OVER (
           ORDER BY src_ord, doc_id, part ROWS UNBOUNDED PRECEDING) AS upto
  FROM ({CLEAN_SQL}))
WHERE upto <= 1000000
""")
def q_byte_budget(spark, sf_dir):
    """L5 on the cleaned corpus: first 1,000,000 bytes (text + newline) in order."""
    cleaned = cut_lineage(C.clean_corpus(flat_corpus(spark, sf_dir)))  # read twice: sized, then cut
    return C.byte_budget(cleaned, 1_000_000).select("src_ord", "doc_id", "part", "text")


@register("doc_lines", oracle=f"""
SELECT doc_id, line_no, line FROM ({DOC_LINES_SQL}) WHERE length(line) > 0
""")
def q_doc_lines(spark, sf_dir):
    """A2/B3/B5 over documents: non-empty LF-separated lines with numbers."""
    return doc_lines(spark, sf_dir)


@register("corpus_text_roundtrip", oracle=f"""
SELECT count(*) AS n_lines, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
FROM ({FLAT_CORPUS_SQL})
""")
def q_corpus_text_roundtrip(spark, sf_dir):
    """Write the flattened corpus as text (one document per line),
    read the files back in listed order, and total lines and bytes."""
    import os

    from ..session import scratch_path
    from ..sources.tables import read_text_lines, write_text
    base = scratch_path(spark, "corpus_text")
    corpus = flat_corpus(spark, sf_dir)
    paths = []
    for i, src in enumerate(["documents", "conversations"]):
        p = os.path.join(base, src)
        write_text(corpus.where(F.col("source") == src).orderBy(*C.CORPUS_ORDER), p)
        paths.append(p)
    back = read_text_lines(spark, paths)
    return back.agg(F.count(F.lit(1)).alias("n_lines"),
                    F.sum(F.octet_length("line")).cast("long").alias("n_bytes"))


@register("write_counters", oracle=f"""
SELECT source, count(*) AS n_rows, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
FROM ({FLAT_CORPUS_SQL}) GROUP BY source
""")
def q_write_counters(spark, sf_dir):
    """Both sources written as text; rows and bytes observed by the writing job."""
    import os

    from ..session import scratch_path
    from ..sources.tables import write_text_counted
    counts = write_text_counted(flat_corpus(spark, sf_dir), os.path.join(scratch_path(spark, "text"), "t"),
                                ["documents", "conversations"])
    rows = [(s, int(n), int(b)) for s, (n, b) in counts.items() if n]
    return spark.createDataFrame(rows, "source string, n_rows long, n_bytes long")
