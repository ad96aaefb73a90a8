"""Operator 11: brute-force digests, typed parts, long conversations over many tasks."""

import hashlib
import random

from pyspark.sql import functions as F

from loomtext.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, n_turns long"
HOSTILE = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|x", "<\\\\|", "<", "\\", "|", "<|image|>", "", None, "é😀\n", "<|newline|>"]


def rows():
    pick = random.Random(5)
    out = [(c, t, pick.choice(["user", "assistant", "system", "a\nb", "<|im_end|>", None]),
            None if pick.random() < .1 else "".join(pick.choice(HOSTILE) or "" for _ in range(5)), "x", 9)
           for c in range(12) for t in range(pick.randrange(1, 7))]
    out += [(None, 0, "user", "no id", "x", 9), (3, None, "assistant", "null turn", "x", 9)]
    out += [(4, 0, "user", "tie", "x", 9), (4, 0, "user", "tie", "x", 9)]
    out += [(77, t, "assistant" if t % 2 else "user", f"turn {t} " + "w" * (t % 50), "x", 9) for t in range(400)]
    return out + [(78, 0, "assistant", "long " * 20000, "x", 9)]


def expect(table):
    convs = {}
    for c, t, role, text, *_ in table:
        convs.setdefault(c, []).append(((t is not None, t or 0, role or "", text or "")))
    found = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        found[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
                    len(said), hashlib.sha256(said.encode()).hexdigest())
    return found


def by_conv(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_digests_equal_brute_force(spark):
    table = rows()
    want = expect(table + [(-1, 0, "user", C.HOSTILE), (-1, 1, "assistant", C.HOSTILE)])
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    assert by_conv(C.formatted_digests(df)) == want
    # small chunks and many tasks cut conversations; the results stay
    assert by_conv(C.formatted_digests(df, chunk=200, partitions=13)) == want


def test_empty_table_formats_the_added_conversation(spark):
    assert set(by_conv(C.formatted_digests(spark.createDataFrame([], SCHEMA)))) == {-1}


def test_typed_parts_become_placeholders(spark):
    turns = spark.sql("""
      SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('type', 'text', 'text', 'see <|image|> ', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'width', 57L, 'height', 28L, 'seconds', null, 'pages', null),
        named_struct('type', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 2.5D, 'pages', null),
        named_struct('type', 'document', 'text', null, 'ref', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 3L),
        named_struct('type', 'hologram', 'text', null, 'ref', 'd', 'width', null, 'height', null, 'seconds', null, 'pages', null)) AS parts
      UNION ALL SELECT 1L, 1L, 'assistant', array(
        named_struct('type', 'text', 'text', 'a', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'image', 'text', null, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', null, 'text', 'b', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null))
      UNION ALL SELECT 1L, 2L, 'user', null""")
    row, = C.format_conversations(turns, parts=F.col("parts"), partitions=1).collect()
    assert row.formatted == (
        "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|attachment|><|im_end|>\n"
        "<|im_start|>assistant\na<|image|>b<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 768), ("attachment", "d", 1),
        ("image", None, 1)]
    assert all(row.formatted[a["at"]:].startswith(f"<|{a.kind}|>") for a in row.attachments)
    assert row.expanded_tokens == 836
    assert "".join(row.formatted[s.start:s.start + s.length] for s in row.loss) == "ab"
    back, = C.read_back(C.format_conversations(turns, parts=F.col("parts"), partitions=1)).collect()
    assert back.loss_chars == 2 and back.n_turns == 3
