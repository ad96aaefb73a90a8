"""Operator 1: scoring by a probabilistic suffix tree over words.

The tree's contexts have up to ``MAX_DEPTH`` words.  A context is a candidate
when it is seen ``least_count`` times in the training documents (twice, at any
size), and is retained when its next-word distribution diverges from that of its
suffix by at least ``DIVERGENCE`` bits.  Next words seen as often after the context
keep a discounted probability; the rest of the mass goes to the suffix'
distribution, renormalised, down to the add-one unigram model.  A token is scored
in the longest retained suffix of its history.

A context and all its suffixes end with the same word, so tokens are dealt by the
word before them: each token travels once, with the three words before it and its
document, and the part that gets it has all that its contexts' counts, weights and
scores need.  A part learns from its training tokens, scores all of its tokens, and
hands back one number for each document.

Contexts of more than ``GROUP`` tokens are hot: their tokens are dealt on, by the context
that is a word longer (by place in the end), to parts of their own.  Hot contexts are
counted beforehand, a length at a time, and what they say of their next words is sent
to each of their parts; that is at most a part's distinct words for a part of ``GROUP`` tokens.

Frequent words' counts are sent to the tasks (bounded: 1/``SYMBOL_SHARE``); those of
other words are joined, one row for each part and distinct word.

Words and contexts are compared by a 64-bit hash.  Defined cases: null and empty texts
have the end token alone; a null key is training data; repeated rows are
separate; without training data N = V = 0 and every token has probability one
(log10 0); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import discard, materialize, release, text_or_empty
from .text_hash import buffers, mix, word_hashes

MAX_DEPTH, SYMBOL_SHARE = 3, 1e-6
#: A context is hot with more tokens than GROUP, and than this share of them (bounds the hot ones).
GROUP, HOT_SHARE = 1 << 20, 1e-6
#: Shares of the training tokens that raise the least counts; none by default.
PAIR_SHARE, CONTEXT_SHARE = 0.0, 0.0
DIVERGENCE, DISCOUNT = 0.005, 0.5
FOLDS, HELD_OUT = 7, 2
START, END, VOID = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B), np.uint64(0x3C6EF372FE94F82B)
#: Texts hashed at a time; tokens that a task deals at a time; bits of a word's number that two of them are sorted by.
STEP, MERGE, WORD_BITS = 128, 1 << 19, 21
#: Tokens of a part, on average, and how many of them are scored at a time.
PART, AT_ONCE = 3 << 19, 1 << 18


def fold(key: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield batch.slice(i, STEP)


class Tree:
    """The frequent words and the totals; picklable, of bounded size.

    Words have numbers: the three marks, then the frequent words, most frequent first;
    from ``size`` on, other words by their place in a table that the caller has.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, docs: int):
        self.n, self.v, self.docs = n, v, docs
        self.least, self.least_context = least_count(PAIR_SHARE, n), least_count(CONTEXT_SHARE, n)
        order = np.lexsort((words, -counts))
        self.counts = np.concatenate([[0, docs, 0], counts[order]])
        codes = np.concatenate([np.array([START, END, VOID]), words[order]])
        self.number = np.argsort(codes).astype(np.int32)
        self.codes = codes[self.number]  # sorted
        self.size = len(codes)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def numbered(self, codes: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct words, the rare ones' by their place among ``others``, and these: by
        default, the rare ones here.  Words of neither have -1."""
        at, known = _find(self.codes, codes)
        others = codes[~known] if others is None else others
        place, other = _find(others, codes)
        return np.where(known, self.number[at], np.where(other, self.size + place, -1)).astype(np.int32), others


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether each code is there."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.searchsorted(table, codes)
    at[at == len(table)] = 0
    return at, table[at] == codes


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them each key is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


def least_count(share: float, n: int) -> int:
    return max(2, math.ceil(share * n))


def _join_codes(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Code of the gram whose words but the last are ``ctx`` and but the first ``low``."""
    h = ctx * np.uint64(0x9E3779B97F4A7C15) + low
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _tokens(column: pa.Array):
    """Per text [START, words, END]: codes, places in the text, and first tokens."""
    h, bounds = word_hashes(*buffers(column))
    first = np.concatenate([[0], np.cumsum(np.diff(bounds) + 2)])
    code = np.empty(first[-1], np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[:-1]], inside[first[1:] - 1] = False, False
    code[inside], code[first[:-1]], code[first[1:] - 1] = h, START, END
    place = (np.arange(len(code)) - np.repeat(first[:-1], np.diff(first))).astype(np.int32)
    return code, place, first


def _longer(code: np.ndarray) -> np.ndarray:
    """Codes of the grams of one word more that end at each token; the first is void."""
    out = code.copy()
    out[1:] = _join_codes(code[:-1], code[1:])
    return out


class Chunk(NamedTuple):
    """Some texts: their keys, and word, place and text of each token."""

    first: int  # row id of the first; the others follow
    keys: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    code: np.ndarray
    place: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)


def _chunks(batches):
    """Texts of about MERGE tokens at a time."""
    held, size, following = [], 0, None

    def joined():
        rids, keys, held_out, code, place, sizes = zip(*held, strict=True)
        held.clear()
        return Chunk(rids[0], pa.chunked_array(keys).combine_chunks(), np.concatenate(held_out), np.concatenate(sizes),
                     np.concatenate(code), np.concatenate(place))

    for b in _slices(batches):
        rid = b.column("rid")[0].as_py()
        if held and rid != following:
            yield joined()
            size = 0
        following = rid + b.num_rows
        code, place, first = _tokens(b.column("text"))
        held.append((rid, b.column("key"), b.column("held_out").to_numpy(zero_copy_only=False), code, place, np.diff(first)))
        size += len(code)
        del code, place, first
        if size > MERGE:
            yield joined()
            size = 0
    if held:
        yield joined()


def _sums(codes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct codes: where one is, times in training documents, and times in all."""
    order = np.argsort(codes)
    at = _starts(codes[order])
    n = np.add.reduceat(learn[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return order[at], n, np.diff(np.append(at, len(codes)))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _count_words(batches):
    for c in _chunks(batches):
        words = np.flatnonzero((c.place > 0) & (c.code != END))
        code = c.code[words]
        at, n, every = _sums(code, ~c.held[c.docs[words]])
        yield pa.RecordBatch.from_arrays([_long(x) for x in (code[at], n, every)], names=["code", "n", "every"])


def _count_hot(hot: np.ndarray, length: int):
    """Counts of the grams of a hot context of ``length`` words and the next word."""
    def run(batches):
        for c in _chunks(batches):
            low = c.code
            for _ in range(length - 1):
                low = _longer(low)
            at = np.flatnonzero(c.place >= length)
            at = at[_find(hot, low[at - 1])[1]]
            ctx, low = low[at - 1], low[at]
            code = _join_codes(ctx, low)
            one, n, every = _sums(code, ~c.held[c.docs[at]])
            yield pa.RecordBatch.from_arrays(
                [_long(x) for x in (code[one], ctx[one], low[one], c.code[at[one]], n, every)],
                names=["code", "ctx", "low", "word", "n", "every"])
    return run


class Hot(NamedTuple):
    """The hot contexts of one length; of bounded number."""

    codes: np.ndarray  # sorted
    low: np.ndarray  # codes of their suffixes, hot too
    n: np.ndarray
    shares: np.ndarray  # how many parts each has
    first: np.ndarray  # and which is its first
    weight: np.ndarray
    retained: np.ndarray


def _hot(rows: list, first: int, group: int) -> Hot:
    code, low, n, every = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    order = np.argsort(code.view(np.uint64))
    shares = -(-every[order] // group)
    return Hot(code.view(np.uint64)[order], low.view(np.uint64)[order], n[order], shares,
               first + np.cumsum(shares) - shares, np.zeros(len(order)), np.zeros(len(order), bool))


def _judged(n, kept, below, bits, least_context: int) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are retained, and the weights (log10) of what lies below them.

    ``kept``: discounted counts, ``below``: the suffix' probabilities, ``bits``: counts
    times log2 of counts over these probabilities; sums over the repeated next words.
    """
    n = np.maximum(n, 1)
    share = kept / n
    rest = 1 - share
    over = np.maximum(rest, 1e-12) / np.maximum(1 - below, 1e-12)
    bits = bits / n - share * np.log2(n) + rest * np.log2(over)
    retained = (kept > 0) & (rest > 0) & (n >= least_context) & (bits >= DIVERGENCE)
    return retained, np.where(retained, np.log10(over), 0.0)


def _parts(c: Chunk, at: np.ndarray, word_part: np.ndarray, levels: list[Hot]) -> np.ndarray:
    """The part of each of some tokens (never a text's first)."""
    part = word_part
    some, code = np.arange(len(at)), c.code
    for length, hot in enumerate(levels, 1):
        i, known = _find(hot.codes, code[at[some] - 1])
        known &= c.place[at[some]] >= length
        some, i = some[known], i[known]
        if not len(some):
            break
        code = _longer(code)
        # By place where the text has no longer context, and for the last length.
        more = (c.place[at[some]] > length) & (length < MAX_DEPTH)
        by = np.where(more, code[at[some] - 1], mix(at[some].astype(np.uint64)))
        part[some] = hot.first[i] + (by % hot.shares[i].astype(np.uint64)).astype(np.int64)
    return part


def _dealt(tree: Tree, c: Chunk, parts: int, levels: list[Hot]):
    """The rare words; places of all tokens but the first, their words and the three before each
    (earliest first) by number, and their parts."""
    words, place = _dense(c.code)
    numbers, rare = tree.numbered(words)
    number, part = numbers[place], (mix(words) % np.uint64(parts)).astype(np.int64)
    at = np.flatnonzero(c.place > 0)
    part = part[place[at - 1]]
    del words, place
    void = tree.numbered(np.array([VOID]))[0][0]
    w = [np.where(c.place[at] >= back, number[at - back], void) for back in (3, 2, 1, 0)]
    return rare, at, w, _parts(c, at, part, levels)


def _rare(tree: Tree, parts: int, levels: list[Hot]):
    """(part, word) of each part's words whose counts are not sent to the tasks."""
    def run(batches):
        for c in _chunks(batches):
            words, _, w, part = _dealt(tree, c, parts, levels)
            rare = np.flatnonzero(w[3] >= tree.size)
            both, n = np.unique(part[rare] * len(words) + (w[3][rare] - tree.size)), max(len(words), 1)
            yield pa.RecordBatch.from_arrays([_long(both // n), _long(words[both % n])], names=["part", "word"])
    return run


DEALT = "part long, first long, n long, words binary, tokens binary, docs binary, learn binary, " \
    "keys array<bigint>, held array<boolean>, sizes array<bigint>, known array<bigint>, base array<double>"


def _deal(tree: Tree, parts: int, levels: list[Hot]):
    """A row for each part with all its tokens of some texts, and a row of the texts' keys, sizes and
    what their frequent words add."""
    def run(batches):
        for c in _chunks(batches):
            rare, at, w, part = _dealt(tree, c, parts, levels)
            docs = c.docs[at]
            counts = np.append(tree.counts, np.full(len(rare), -1))
            known = np.bincount(docs, weights=(counts > 0)[w[3]], minlength=len(c.sizes)).astype(np.int64)
            base = np.bincount(docs, weights=np.where(counts < 0, 0, tree.base(np.maximum(counts, 0)))[w[3]],
                               minlength=len(c.sizes))
            rows = [{"part": -1 - c.first, "first": c.first, "keys": c.keys.to_pylist(), "held": c.held.tolist(),
                     "sizes": (c.sizes - 1).tolist(), "known": known.tolist(), "base": base.tolist()}]
            if max(len(counts), part.max()) < 1 << WORD_BITS - 1:  # runs of equal words take little room
                order = np.argsort(part << 2 * WORD_BITS | w[2].astype(np.int64) << WORD_BITS | w[1])
            else:
                order = np.lexsort((w[1], w[2], part))
            part, docs = part[order], docs[order]
            for i in range(4):
                w[i] = w[i][order]
            del order, at
            bounds = np.append(_starts(part), len(part))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine = np.stack([x[a:b] for x in w])
                others = mine >= tree.size
                used, place = _dense(mine[others] - tree.size)
                mine[others] = tree.size + place
                rows.append({"part": int(part[a]), "first": c.first, "n": int(b - a), "words": rare[used].tobytes(),
                             "tokens": _packed(mine.ravel()), "docs": _packed(docs[a:b]), "learn": np.packbits(~c.held[docs[a:b]]).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=DEALT_ARROW)
    return run


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits by byte, least first; most of the others are zero."""
    return pa.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(packed: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


DEALT_ARROW = pa.schema([
    *((c, pa.int64()) for c in ("part", "first", "n")), *((c, pa.binary()) for c in ("words", "tokens", "docs", "learn")),
    ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    *((c, pa.list_(pa.int64())) for c in ("sizes", "known")), ("base", pa.list_(pa.float64()))])
#: What a part adds to the documents of a row: which, and how much; rare words' base and known words.
ADDED = "first long, docs binary, score binary, rare_docs binary, rare_base binary, rare_known binary, " \
    "keys array<bigint>, held array<boolean>, sizes array<bigint>, known array<bigint>, base array<double>"
ADDED_ARROW = pa.schema([
    ("first", pa.int64()), *((c, pa.binary()) for c in ("docs", "score", "rare_docs", "rare_base", "rare_known")),
    *list(DEALT_ARROW)[-5:]])


def _score(w: list[np.ndarray], void: int, size: int, learn: np.ndarray, root: np.ndarray,
           known: list[tuple[np.ndarray, np.ndarray, float]], tree: Tree) -> np.ndarray:
    """log10 probabilities of a part's tokens.

    ``w``: by word, numbers below ``size`` of the three words before each token and its own;
    ``root``: by number, the unigram model; ``known``: by length, what a hot context that all
    tokens share says: by number, which words it repeats and their value, and its weight.
    """
    score = root[w[3]]
    # Of the tokens whose context may have a longer one: its number, and whether its gram with the token is repeated.
    some, ctx, repeated = np.arange(len(score), dtype=np.int32), np.zeros(len(score), np.int64), np.ones(len(score), bool)
    for length in range(1, MAX_DEPTH + 1):
        if length <= len(known):
            found, value, weight = known[length - 1]
            repeated = found[w[3]]
            score = np.where(repeated, value[w[3]], score + weight)
            continue
        word = w[3 - length][some]
        there = word != void
        some, repeated = some[there], repeated[there]
        _, ctx = _dense(ctx[there] * size + word[there])
        n = np.bincount(ctx, weights=learn[some])
        often = n[ctx] >= tree.least_context
        some, repeated, ctx = some[often], repeated[often], ctx[often]
        if not len(some):
            break
        grams = np.flatnonzero(repeated)
        keys = ctx[grams] * size + w[3][some[grams]]
        order = np.argsort(keys)
        keys, tokens = keys[order], some[grams[order]]
        at = _starts(keys)
        if not len(at):
            break
        times = np.diff(np.append(at, len(keys)))
        count = np.add.reduceat(learn[tokens].astype(np.int64), at)
        keep = count >= tree.least
        mine, count, below = keys[at][keep] // size, count[keep], score[tokens[at]][keep]
        cut = count - DISCOUNT
        retained, weight = _judged(n, *(np.bincount(mine, weights=x, minlength=len(n)) for x in (
            cut, 10.0 ** below, cut * (np.log2(cut) - below / math.log10(2)))), tree.least_context)
        score[some] += weight[ctx]
        value = np.zeros(len(at))
        value[keep] = np.where(retained[mine], np.log10(cut / n[mine]), below)
        longest = np.repeat(keep, times)
        score[tokens[longest]] = np.repeat(value, times)[longest]
        repeated[:] = False
        repeated[grams[order[longest]]] = True
    return score


def _add(tree: Tree, levels: list[Hot]):
    """What one part adds to its documents, a row for each row that was dealt to it."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            return pa.Table.from_pylist(left.select([f.name for f in ADDED_ARROW if f.name in left.column_names
                                                     and f.name != "docs"]).to_pylist(), schema=ADDED_ARROW)
        if not left.num_rows:
            return ADDED_ARROW.empty_table()
        rows = {c: [x.as_buffer() for x in left[c]] for c in ("words", "tokens", "docs", "learn")}  # not copied
        words, place = _dense(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["words"]]))
        bounds, before, docs = np.cumsum([0, *left["n"].to_pylist()]), 0, []
        w, learn = np.empty((4, bounds[-1]), np.int32), np.empty(bounds[-1], bool)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            mine = _unpacked(rows["tokens"][i], int(4 * (b - a)))
            others = mine >= tree.size
            mine[others] = tree.size + place[before + mine[others] - tree.size]
            before += rows["words"][i].size // 8
            w[:, a:b] = mine.reshape(4, -1)
            learn[a:b] = np.unpackbits(np.frombuffer(rows["learn"][i], np.uint8), count=b - a)
            docs.append(_unpacked(rows["docs"][i], int(b - a)))
        del place, rows
        size = tree.size + len(words)
        # Counts of words and, by length, what hot contexts say, by the words' numbers.
        kind, value = right["kind"].to_numpy(), right["value"].to_numpy()
        number, _ = tree.numbered(right["word"].to_numpy().view(np.uint64), words)
        counts = np.concatenate([tree.counts, np.zeros(len(words))])
        counts[number[kind == 0]] = value[kind == 0]
        root, known = tree.base(counts), []
        for length, weight in enumerate(_weights(part, levels), 1):
            mine = (kind == length) & (number >= 0)
            found, say = np.zeros(size, bool), np.zeros(size)
            found[number[mine]], say[number[mine]] = True, value[mine]
            known.append((found, say, weight))
        void = int(tree.numbered(np.array([VOID]))[0][0])
        # Some at a time: tokens of one context together, by its first word that is not shared by all.
        steps = -(-len(learn) // AT_ONCE)
        step = (w[2 - len(known)] if len(known) < MAX_DEPTH else np.arange(len(learn))) % steps
        score = np.empty(len(learn))
        for i in range(steps):
            mine = np.flatnonzero(step == i)
            score[mine] = _score([x[mine] for x in w], void, size, learn[mine], root, known, tree)
        rare = w[3] >= tree.size
        out = []
        for first, local, a, b in zip(left["first"].to_pylist(), docs, bounds[:-1], bounds[1:], strict=True):
            word, other = w[3][a:b], rare[a:b]
            all_docs, (added,) = _by_document(local, score[a:b] - np.where(other, 0, root[word]))
            rare_docs, (base, known) = _by_document(local[other], root[word[other]], counts[word[other]] > 0)
            out.append({"first": first, "docs": all_docs, "score": added, "rare_docs": rare_docs,
                        "rare_base": base, "rare_known": known})
        return pa.Table.from_pylist(out, schema=ADDED_ARROW)
    return run


def _by_document(docs: np.ndarray, *values: np.ndarray) -> tuple[bytes, list[bytes]]:
    """A bit for each document up to the last one, and the sums of those that are set."""
    found, which = _dense(docs)
    on = np.zeros(found[-1] + 1 if len(found) else 0, bool)
    on[found] = True
    return np.packbits(on).tobytes(), [np.bincount(which, weights=x, minlength=len(found)).tobytes() for x in values]


def _weights(part: int, levels: list[Hot]) -> list[float]:
    """By length, the weights of the hot contexts that all tokens of a part share."""
    for length in range(len(levels), 0, -1):
        hot = levels[length - 1]
        at = np.flatnonzero((hot.first <= part) & (part < hot.first + hot.shares))
        if len(at):
            i, out = at[0], []
            for level in range(length, 0, -1):
                out.append(float(levels[level - 1].weight[i]))
                if level > 1:
                    i = _find(levels[level - 2].codes, levels[level - 1].low[i:i + 1])[0][0]
            return out[::-1]
    return []


def _sum_up(table: pa.Table) -> pa.Table:
    """Rows of the texts of one chunk, from what all parts add to them."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["keys"] is not None)
    base, known = np.array(head["base"], np.float64), np.array(head["known"], np.float64)
    more = np.zeros(len(base))
    for r in rows:
        if r["keys"] is None:
            for bits, values, to in (("docs", "score", more), ("rare_docs", "rare_base", base), ("rare_docs", "rare_known", known)):
                on = np.flatnonzero(np.unpackbits(np.frombuffer(r[bits], np.uint8)))
                to[on] += np.frombuffer(r[values])
    return pa.table({"key": pa.array(head["keys"], pa.int64()), "held_out": pa.array(head["held"], pa.bool_()),
                     "n_tokens": pa.array(head["sizes"], pa.int64()), "n_known": known.astype(np.int64), "base": base,
                     "score": np.array(head["base"], np.float64) + more})


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder; shuffle files of what it was made from may go."""
    out = materialize(df, name)
    release(df.sparkSession)
    return out


def hot_contexts(rows: DataFrame, tree: Tree, words: DataFrame, starts: int, parts: int) -> tuple[list[Hot], list[DataFrame]]:
    """By length, the hot contexts, and (code, ctx, word, value): what they say of the words they repeat."""
    spark, group = rows.sparkSession, max(GROUP, math.ceil(HOT_SHARE * tree.n))
    found = [(r.code, 0, r.n, r.every) for r in words.where(F.col("every") > group).select("code", "n", "every").collect()]
    if starts > group:
        found.append((int(START.view(np.int64)), 0, tree.docs, starts))
    root = F.log10((F.col("n") + 1) / F.lit(float(tree.n + tree.v + 1)))
    ends = spark.createDataFrame([(int(END.view(np.int64)), tree.docs)], "code long, n long")
    lower = words.select("code", "n").unionByName(ends).select(F.col("code").alias("low"), root.alias("below"))
    levels, said, first = [], [], parts
    for length in range(1, MAX_DEPTH + 1):
        if not found:
            break
        hot = _hot(found, first, group)
        first += int(hot.shares.sum())
        counted = _stored(rows.mapInArrow(_count_hot(hot.codes, length), ", ".join(
            f"{c} long" for c in ("code", "ctx", "low", "word", "n", "every"))).groupBy("code").agg(
            *(F.first(c).alias(c) for c in ("ctx", "low", "word")), *(F.sum(c).alias(c) for c in ("n", "every")))
            .where((F.col("n") >= tree.least) | (F.col("every") > group)), f"hot-{length}")
        cut, p_below = F.col("n") - DISCOUNT, F.pow(F.lit(10.0), F.col("below"))
        repeated = _stored(counted.where(F.col("n") >= tree.least).join(lower, "low"), f"hot-below-{length}")
        sums = repeated.groupBy("ctx").agg(F.sum(cut).alias("kept"), F.sum(p_below).alias("below"),
                                           F.sum(cut * F.log2(cut / p_below)).alias("bits")).collect()
        at = _find(hot.codes, np.array([r.ctx for r in sums], np.int64).view(np.uint64))[0]
        of = {c: np.zeros(len(hot.codes)) for c in ("kept", "below", "bits")}
        for c, x in of.items():
            x[at] = [r[c] for r in sums]
        retained, weight = _judged(hot.n, of["kept"], of["below"], of["bits"], tree.least_context)
        levels.append(hot._replace(retained=retained, weight=weight))
        own = spark.createDataFrame(list(zip(hot.codes.view(np.int64).tolist(), hot.n.tolist(), retained.tolist(), strict=True)),
                                    "ctx long, total long, retained boolean")
        table = _stored(repeated.join(F.broadcast(own), "ctx").select(
            "code", "ctx", "word", F.when(F.col("retained"), F.log10(cut / F.col("total"))).otherwise(F.col("below"))
            .alias("value")), f"hot-said-{length}")
        said.append(table)
        lower = table.select(F.col("code").alias("low"), F.col("value").alias("below"))
        found = [(r.code, r.low, r.n, r.every) for r in counted.where(
            (F.col("every") > group) & (F.col("word") != int(END.view(np.int64)))).collect()]
        discard(counted)
        discard(repeated)
    return levels, said


def _lookups(rows: DataFrame, tree: Tree, words: DataFrame, parts: int, levels: list[Hot], said: list[DataFrame]) -> DataFrame:
    """(part, kind, word, value): rare words' counts (0), and by length what hot contexts say, for the parts that need them."""
    out = [rows.mapInArrow(_rare(tree, parts, levels), "part long, word long").distinct()
           .join(words.select(F.col("code").alias("word"), "n"), "word")
           .select("part", F.lit(0).alias("kind"), "word", F.col("n").cast("double").alias("value"))]
    needs = [[] for _ in levels]
    for length, hot in enumerate(levels, 1):
        for i in range(len(hot.codes)):
            own, at = range(int(hot.first[i]), int(hot.first[i] + hot.shares[i])), i
            for level in range(length, 0, -1):
                of = levels[level - 1]
                needs[level - 1] += [(int(of.codes[at].view(np.int64)), part) for part in own]
                if level > 1:
                    at = _find(levels[level - 2].codes, of.low[at:at + 1])[0][0]
    for length, (need, table) in enumerate(zip(needs, said, strict=True), 1):
        at = rows.sparkSession.createDataFrame(need, "ctx long, part long")
        out.append(table.join(F.broadcast(at), "ctx").select("part", F.lit(length).alias("kind"), "word", "value"))
    return reduce(DataFrame.unionByName, out)


def train(rows: DataFrame) -> tuple[Tree, DataFrame, int, list[Hot], list[DataFrame]]:
    """The frequent words, the table (code, n, every) of all words, how many parts there are besides
    those of hot contexts, and these."""
    words = _stored(rows.mapInArrow(_count_words, "code long, n long, every long").groupBy("code").agg(
        F.sum("n").alias("n"), F.sum("every").alias("every")), "words")
    total, every, distinct = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "every")),
                                       F.count(F.when(F.col("n") > 0, 1))).first()
    docs, starts = rows.agg(F.count(F.when(~F.col("held_out"), 1)), F.count(F.lit(1))).first()
    n, v = total + docs, distinct + (docs > 0)
    # At most 1 / SYMBOL_SHARE of the most frequent words; down to this share there are no more, since the counts add up to n.
    least = least_count(SYMBOL_SHARE, n)
    times = words.groupBy(F.least("n", F.lit(least)).alias("n")).count().orderBy(F.desc("n")).collect()
    room = 1 / SYMBOL_SHARE
    for r in times:
        room -= r["count"]
        if room < 0 or r["n"] == 0:
            break
        least = r["n"]
    some = words.where(F.col("n") >= least).select("code", "n").toArrow()
    tree = Tree(some["code"].to_numpy().view(np.uint64), some["n"].to_numpy(), n, v, docs)
    parts = max(1, -(-(every + starts) // PART))
    return tree, words, parts, *hot_contexts(rows, tree, words, starts, parts)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"),
                       (fold(key) == HELD_OUT).alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    tree, words, parts, levels, said = train(rows)
    lookups = _stored(_lookups(rows, tree, words, parts, levels, said), "lookups")
    for table in (words, *said):
        discard(table)
    added = rows.mapInArrow(_deal(tree, parts, levels), DEALT).groupBy("part").cogroup(lookups.groupBy("part")) \
        .applyInArrow(_add(tree, levels), ADDED)
    return added.groupBy("first").applyInArrow(
        _sum_up, "key long, held_out boolean, n_tokens long, n_known long, base double, score double").select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(tree.n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")
