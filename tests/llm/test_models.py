"""Language model, personal data, secrets and quality against brute force or held-out data."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import LOWER, texts_of  # noqa: I001
from loomtext.llm import markov_secrets, quality_mil, spans, suffix_tree_lm, weak_pii

# ---- op1 -----------------------------------------------------------------


def lm_tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]


def lm_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in lm_tokens(t))
    return held, c, sum(c.values()), len(c)


def test_lm_base_and_counts(edges, docs, no_docs):
    for df in (edges, docs):
        rows = texts_of(df)
        held, c, n, v = lm_base(rows)
        got = suffix_tree_lm.scores(df).collect()
        key = lambda i, h, k, s: (i, h, k, round(s, 6))
        want = Counter(key(i, h, (len(t), sum(c[w] > 0 for w in t), n), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
                       for (i, _), h, t in ((r, h, lm_tokens(r[1])) for r, h in zip(rows, held, strict=True)))
        assert Counter(key(r.doc_id, r.held_out, (r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in got) == want
        assert all(r.score <= 1e-9 for r in got)
    assert suffix_tree_lm.scores(no_docs).count() == 0


def brute_tree(rows, held):
    """The model by its definition, on tuples of words."""
    M = suffix_tree_lm
    train = [lm_tokens(t) for (_, t), h in zip(rows, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    least = lambda share: max(2, math.ceil(share * n))
    root = lambda w: (c[w] + 1) / (n + v + 1)
    top = {w for w in c if c[w] >= least(M.PAIR_SHARE)} | {None}
    seqs = [["<start>", *t] for t in train]
    cand = {(w,): c[w] for w in top if w is not None and c[w] >= least(M.CONTEXT_SHARE)}
    if len(train) >= least(M.CONTEXT_SHARE):
        cand[("<start>",)] = len(train)
    nodes = {}

    def prob(ctx, w):
        weight = 1.0
        while ctx:
            if ctx in nodes:
                p, bow = nodes[ctx]
                if w in p:
                    return weight * p[w]
                weight *= bow
            ctx = ctx[1:]
        return weight * root(w)
    for depth in range(1, M.MAX_DEPTH + 1):
        pairs = Counter()
        for s in seqs:
            for i in range(depth, len(s)):
                ctx = tuple(s[i - depth:i])
                if ctx in cand and s[i] in top:
                    pairs[(ctx, s[i])] += 1
        pairs = {k: x for k, x in pairs.items() if x >= least(M.PAIR_SHARE)}
        new = {}
        for ctx, total in cand.items():
            p = {w: (x - M.DISCOUNT) / total for (cx, w), x in pairs.items() if cx == ctx}
            below = {w: prob(ctx[1:], w) for w in p}
            rest, rest_below = 1 - sum(p.values()), 1 - sum(below.values())
            if p and rest > 0:
                bits = sum(x * math.log2(x / below[w]) for w, x in p.items()) + rest * math.log2(rest / rest_below)
                if bits >= M.DIVERGENCE:
                    new[ctx] = (p, rest / rest_below)
        grown = {ctx + (w,): x for (ctx, w), x in pairs.items()
                 if w is not None and x >= least(M.CONTEXT_SHARE) and (ctx + (w,))[1:] in cand}
        nodes |= new
        cand = grown
    return prob


def test_lm_scores_match_definition(spark, monkeypatch):
    for name, value in (("PAIR_SHARE", 0.004), ("CONTEXT_SHARE", 0.01), ("SYMBOL_SHARE", 0.003)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 25)):
            text += rnd.choice([["a", "b", "c", "d"], ["a", "b", "e"], ["x"], [f"r{rnd.randrange(60)}"]])
        rows.append((i, " ".join(text)))
    held, *_ = lm_base(rows)
    prob = brute_tree(rows, held)
    got = {r.doc_id: r for r in suffix_tree_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    better = 0
    for i, t in rows:
        s = ["<start>", *lm_tokens(t)]
        want = sum(math.log10(prob(tuple(s[max(0, j - suffix_tree_lm.MAX_DEPTH):j]), s[j])) for j in range(1, len(s)))
        assert got[i].score == pytest.approx(want, abs=1e-6), (i, t)
        better += got[i].score > got[i].base_score
    assert better > 45
    words = set(lm_base(rows)[1])
    for ctx in [("<start>",), ("a",), ("a", "b"), ("c", "d", "a")]:
        assert sum(prob(ctx, w) for w in words | {"unseen"}) <= 1.0 + 1e-9


@pytest.mark.parametrize("hot_share", [1e-6, 0.05])
def test_lm_keeps_repeated_pairs_at_any_size(spark, monkeypatch, hot_share):
    """A pair seen a few times among very many tokens is in the model, broadcast or joined."""
    monkeypatch.setattr(suffix_tree_lm, "HOT_SHARE", hot_share)
    many = " ".join(f"f{i % 50}" for i in range(10000))
    rows = [(i, many) for i in range(100)] + [(100 + i, "rare pair of words") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held, *_ = lm_base(rows)
    assert held[100:].count(False) * 1e6 < 10 * sum(len(lm_tokens(t)) for _, t in rows)
    got = {r.doc_id: r for r in suffix_tree_lm.scores(df).collect()}
    assert got[100].score > got[100].base_score + 10
    small = [r for r in rows if r[0] >= 94]
    prob = brute_tree([(i, t[:2000]) for i, t in small], lm_base(small)[0])
    cut = {r.doc_id: r for r in suffix_tree_lm.scores(spark.createDataFrame(
        [(i, t[:2000]) for i, t in small], "doc_id long, text string")).collect()}
    for i, t in small:
        s = ["<start>", *lm_tokens(t[:2000])]
        want = sum(math.log10(prob(tuple(s[max(0, j - 3):j]), s[j])) for j in range(1, len(s)))
        assert cut[i].score == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("group, part, merge, bits", [(40, 300, 200, 21), (8, 100, 50, 4), (1 << 20, 60, 1 << 21, 21)])
def test_lm_parts_and_hot_contexts(spark, monkeypatch, group, part, merge, bits):
    """Scores do not depend on how tokens are dealt; hot contexts of one to three words, rare words, repeated rows."""
    for name, value in (("GROUP", group), ("PART", part), ("MERGE", merge), ("WORD_BITS", bits), ("STEP", 7), ("AT_ONCE", 64), ("SYMBOL_SHARE", 0.02)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    rnd = random.Random(11)
    rows = []
    for i in range(90):
        text = []
        for _ in range(rnd.randint(0, 12)):
            text += rnd.choice([["a", "b", "c", "d"], ["a", "b", "c", f"e{rnd.randrange(9)}"], ["a", "b"], ["a"], [f"r{rnd.randrange(60)}"]])
        rows.append((i % 80, " ".join(text)))
    rows += [(None, "a b c d a b"), (None, None), (1000, "never seen words a b c")]
    held, *_ = lm_base(rows)
    prob = brute_tree(rows, held)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    inner = suffix_tree_lm.train
    monkeypatch.setattr(suffix_tree_lm, "train", lambda r: seen.append(inner(r)) or seen[-1])
    got = Counter((r.doc_id, round(r.score, 6)) for r in suffix_tree_lm.scores(df).collect())
    want = Counter()
    for i, t in rows:
        s = ["<start>", *lm_tokens(t)]
        want[i, round(sum(math.log10(prob(tuple(s[max(0, j - 3):j]), s[j])) for j in range(1, len(s))), 6)] += 1
    assert got == want
    assert len(seen[0][3]) == (3 if group < 1000 else 0)


def test_lm_sends_each_token_once(spark):
    """What tasks hand on grows with the tokens, not with the lengths of the grams."""
    rnd = random.Random(5)
    text = [" ".join(f"w{min(int(rnd.expovariate(0.001)), 20000)}" for _ in range(500)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").select(
        F.col("doc_id").alias("key"), "text", F.lit(False).alias("held_out"), F.col("doc_id").alias("rid")).coalesce(1)
    tree, _, parts, levels, _ = suffix_tree_lm.train(rows)
    sent = rows.mapInArrow(suffix_tree_lm._deal(tree, parts, levels), suffix_tree_lm.DEALT).where("part >= 0").agg(
        F.sum("n"), F.sum(F.octet_length("tokens") + F.octet_length("docs") + F.octet_length("learn")),
        F.sum(F.octet_length("words"))).first()
    assert sent[0] == 400 * 501 and sent[1] < 10 * sent[0] and sent[2] == 0


def test_lm_held_out_gain(docs):
    r = suffix_tree_lm.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# ---- op3 -----------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_base(t):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                    "card": 16 <= len(d) <= 19 and weak_pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_rules():
    rnd = random.Random(2)
    parts = ["a", "b.", "@", "@x.y", "1", "25", "256", ".", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "%", "0"]
    for _ in range(20000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [f"{k}:{s}:{e}" for k, s, e in weak_pii.base_spans(t)] == pii_base(t), t
    weak_pii.base_spans("a" * 200000 + "@" + "1" * 100000 + "+" * 100000)  # linear


def test_pii_query(edges, docs, no_docs):
    for df in (edges, docs):
        want = Counter()
        for i, t in texts_of(df):
            s = pii_base(t)
            want[(i, *(sum(x.startswith(k) for x in s) for k in RULES), hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
        got = weak_pii.personal_data(df).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        for r in got:
            spans = r.spans.split(",") if r.spans else []
            assert hashlib.sha256(",".join(x for x in spans if not x.startswith("weak")).encode()).hexdigest() == r.base_sha256
            assert sum(x.startswith("weak") for x in spans) == r.n_weak
    assert weak_pii.personal_data(no_docs).count() == 0


def test_pii_weak_spans(spark):
    """Look-alikes with agreeing votes are added, dates and versions are not."""
    rows = [(i, f"write to bob{i}@mail.example.com or call +1 (555) 010-{i:04d} now") for i in range(200)]
    rows += [(1000 + i, f"please call me, phone (555) 123-{i:04d} today") for i in range(60)]
    rows += [(2000 + i, f"license version 2021-03-{10 + i % 15} of the file") for i in range(60)]
    got = {r.doc_id: r for r in weak_pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i].n_weak for i in range(60)) >= 55
    assert sum(got[2000 + i].n_weak for i in range(60)) == 0


def test_pii_candidates_stop_at_neighbours():
    """Base spans and spelt-out addresses end a candidate instead of swallowing it."""
    def found(t):
        return [t[s:e] for s, e, known in weak_pii.candidates(t, weak_pii.base_spans(t)) if not known]
    assert found("at 10.0.0.1 555 123 4567 or 10.0.0.2 030 1234567") == ["555 123 4567", "030 1234567"]
    assert found("ann.b (at) mail [dot] org 5551234567") == ["ann.b (at) mail [dot] org", "5551234567"]
    assert found("(at)(at) x(at)y a(at)b.c d@e.fg 12345678") == ["a(at)b.c", "12345678"]
    assert found("x (555) 123-4567 y") == ["(555) 123-4567"]
    assert found("") == found("(at)") == found(" (at)x.y") == []
    rnd = random.Random(4)
    parts = ["a", "b.", " ", "(at)", "[dot]", "@x.y", "10.0.0.1", "5551234567", "+1 555 123 4567", "(", "-", "é", "12345 "]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        base = weak_pii.base_spans(t)
        more = [(s, e) for s, e, known in weak_pii.candidates(t, base) if not known]
        assert more == sorted(more) and all(a[1] <= b[0] for a, b in zip(more, more[1:], strict=False))
        assert not any(a < e and s < b for s, e in more for _, a, b in base), t


def test_pii_votes_weighed_by_reliability(spark):
    """One vote each way is decided by what the corpus says of both labelers, not lost."""
    rows = [(i, f"write to bob{i}@mail.example.com or call +1 (555) 010-{i:04d} now") for i in range(200)]
    rows += [(1000 + i, f"phone (555) 123-{i:04d} today") for i in range(80)]
    rows += [(2000 + i, f"Telefon nr (555) 123-{i:04d} heute") for i in range(20)]
    rows += [(3000 + i, f"see section version 2021-03-{10 + i % 15} of it") for i in range(80)]
    rows += [(4000 + i, f"Telefon nr +1 (555) 010-{i:04d} heute") for i in range(100)]  # so "nr" speaks against little
    rows += [(5000 + i, f"to 4{i:03d}000000000000 of") for i in range(40)]  # an issuer's digits, a wrong checksum
    rows += [(6000 + i, f"to 7{i:03d}000000000000 of") for i in range(200)]
    rows = [(i, t) for i, t in rows if i < 5000 or not weak_pii.luhn(re.sub("[^0-9]", "", t))]
    got = {r.doc_id: r.n_weak for r in weak_pii.personal_data(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] for i in range(80)) == 80 and sum(got[2000 + i] for i in range(20)) == 20
    assert sum(got[3000 + i] for i in range(80)) == 0
    assert sum(n for i, n in got.items() if i >= 5000) == 0


def test_span_search_is_linear():
    """A text of 1 MB with tens of thousands of spans of each sort takes seconds, not hours."""
    t0 = time.time()
    t = "10.0.0.1 555 123 4567 a(at)b.cd " * 20000 + "a" * 400000 + "(at)" * 20000
    more = [x for x in weak_pii.candidates(t, weak_pii.base_spans(t)) if not x[2]]
    assert len(more) == 40000
    t = ("deadbeef" * 4 + " " + "Zx9" * 8 + " ") * 20000
    ratio = np.ones((markov_secrets.N, markov_secrets.N))
    base = markov_secrets.base_spans(t)
    assert len(base) == 20000 and len(markov_secrets.random_runs(t, base, ratio)) == 20000
    assert time.time() - t0 < 20


def test_spans_against_definition():
    rnd = random.Random(8)
    for _ in range(2000):
        some = [(s, s + rnd.randint(1, 6)) for s in (rnd.randrange(40) for _ in range(rnd.randint(0, 8)))]
        u = spans.union(some)
        inside = {i for s, e in some for i in range(s, e)}
        assert {i for s, e in u for i in range(s, e)} == inside and len(inside) == sum(e - s for s, e in u)
        assert [i for s, e in spans.gaps(u, 50) for i in range(s, e)] == [i for i in range(50) if i not in inside]
        runs = [(s, s + 3) for s in range(rnd.randrange(4), 44, 4)]
        assert list(spans.apart(runs, u)) == [(s, e) for s, e in runs if not inside & set(range(s, e))]


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    acc = np.array([0.95, 0.9, 0.85, 0.55])
    v = np.where(rng.random((4000, 4)) < acc, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    v[rng.random((4000, 4)) < 0.3] = 0
    u, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, theta = weak_pii.reliabilities(u, n.astype(float))
    assert ((post[back.ravel()] > 0.5) == truth).mean() > 0.93
    yes = theta[1, :, 2] / (theta[1, :, 2] + theta[1, :, 0])
    assert yes[0] > yes[3] + 0.2


# ---- op5 -----------------------------------------------------------------

def secret_base(t):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
                         r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or ""):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m.group()) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets_query(edges, docs, no_docs):
    for df in (edges, docs):
        want = Counter()
        for i, t in texts_of(df):
            s = secret_base(t)
            want[(i, *(sum(x.startswith(k) for x in s) for k in markov_secrets.KINDS),
                  hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
        got = markov_secrets.secrets(df).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
        for r in got:
            spans = r.spans.split(",") if r.spans else []
            assert hashlib.sha256(",".join(x for x in spans if not x.startswith("random")).encode()).hexdigest() == r.base_sha256
    assert markov_secrets.secrets(no_docs).count() == 0


def test_secret_base_rules(spark):
    rnd = random.Random(9)
    parts = ["password", "API_KEY", "Token", "=", ": ", "'", '"', "abc123", "x", " ", "AKIA", "ABCDEFGHIJKLMNOP", "0a", "deadbeef",
             "é", "ſecret=abcdefg", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(3000)]
    got = markov_secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        spans = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert spans == secret_base(texts[r.doc_id]), texts[r.doc_id]


def test_markov_adds_random_strings(spark):
    rnd = random.Random(1)
    prose = "the internationalisation of counterrevolutionary misunderstandings disproportionately characterises"
    token = lambda n: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    rows = [(i, f"{prose} secret={token(24)} {prose}") for i in range(150)]
    rows += [(1000 + i, f"{prose} {token(30)} {prose}") for i in range(50)]
    rows += [(2000 + i, f"{prose} {rnd.randrange(10 ** 17, 10 ** 18)} {prose}") for i in range(50)]
    got = {r.doc_id: r for r in markov_secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i].n_random == 1 for i in range(50)) >= 48
    assert all(got[i].n_random == 0 for i in range(150))
    assert all(got[2000 + i].n_random == 0 for i in range(50))  # numbers


def test_runs_do_not_cross_texts():
    from loomtext.llm.text_hash import buffers
    raw, off = buffers(pa.array(["abc", "def", "", "g h", "ij", ""]))
    s, e = markov_secrets._runs(raw, off, 1)
    assert [bytes(raw[a:b]) for a, b in zip(s, e, strict=True)] == [b"abc", b"def", b"g", b"h", b"ij"]


# ---- op6 -----------------------------------------------------------------

def test_quality_held_out(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_mil.quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == r.quality for r in rows if r.held_out]
    assert len(right) > 5 and sum(right) >= len(right) - 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(edges, docs, no_docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_mil.quality(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_mil.quality(no_docs, labels).count() == 0
    none = quality_mil.quality(edges, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality_mil.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_attention_gradient():
    """The update direction lowers the loss: finite differences on a few weights."""
    rng = np.random.default_rng(3)
    x, first, y = rng.standard_normal((9, quality_mil.FEATURES)), np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = quality_mil.fit(x, first, y)
    assert ((model.score(x, first) >= 0.5) == (y == 1)).all()
    assert model.forward(x, first)["p"][:2].sum() == pytest.approx(1)
