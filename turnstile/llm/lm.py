"""Language-model scores by prediction by partial matching over bytes.

A text is read as its lower-cased words joined by single spaces, then one end symbol. The
model is a trie of byte contexts up to ``ORDER`` bytes: how often each symbol followed
each context in the training texts. It is kept as the sorted array of its deepest paths,
read from the most recent byte; shorter contexts are prefixes and their counts are sums.
A symbol is coded in the longest context that has been seen. If it is new there, an escape
is coded (method D: an escape weighs half a count for each distinct symbol) and the next
shorter context follows, without the symbols of the longer one (symbol exclusion); last
comes a uniform code. The code lengths add up to a text's log10 probability.

Neither trie nor word counts are ever gathered in one place. Every chunk of documents asks
for the paths and words it holds, with its own training counts; a bucket of the key space
adds up the counts of all chunks and answers each chunk with the probability of each of its
paths as a product of fractions of whole numbers, without rounding. Paths meet by their
last three bytes of context. The counts of symbols after up to two bytes of context (a table of 2^24 cells,
of which texts of some languages fill a few ten thousand) are summed in a tree and sent
to every task.

``adaptive_code_length`` is the same code learnt while reading one text.

Cases: a null text is empty and scores its end symbol; a null id is in fold 0; repeated
rows count as often as they occur; without training texts every symbol costs a uniform
code; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import NULL_ID, U, Chunk, bucket_count, by_bucket, mix64, pack, with_answers
from .common import Scratch, summed_in_rounds, table, tidy

ORDER = 6
CHUNK_BYTES = 3 << 20
BATCH = 200_000
END = 10  # a line feed: no word holds one
END_WORD = U(0x656E64)  # the key of the end token


class Corpus:
    """A chunk as the model reads it: symbols with their contexts, words with their keys."""

    def __init__(self, ids, lens, blob, held, order: int):
        c = Chunk(ids, lens, blob, lower=True)
        self.ids, self.n_words = c.ids, c.words
        self.train = ~np.asarray(held, bool)
        # Words with one separator each and the end: the single space before a text's first word is dropped.
        raw = c.raw
        texts = [b" ".join(raw[a : a + n].split()) for a, n in zip(c.begin.tolist(), c.lens.tolist())]
        pad = b"\n" * order
        stream = np.frombuffer(b"".join(pad + t + b"\n" for t in texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.symbols = sizes
        kept = np.ones(len(stream), bool)  # all but the padding before each text
        begin = np.cumsum(sizes + order) - sizes - order
        for k in range(order):
            kept[begin + k] = False
        key = np.zeros(len(stream) - order if len(stream) else 0, U)
        for k in range(order, 0, -1):  # from the top: the last byte of context, the one before, ..., the symbol
            key |= stream[order - k : len(stream) - k].astype(U) << U(8 * (order + 1 - k))
        key |= stream[order:]
        self.keys = key[kept[order:]]
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.words = c.hashes()
        self.word_of = c.doc


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of at most 63 bits and how many of each are counted."""
    k = np.sort((keys << U(1)) | counted.astype(U))
    if not len(k):
        return k, np.zeros(0, np.int64)
    c = k & U(1)
    k >>= U(1)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first).astype(np.int64)


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, in planes of bytes, with their counts."""
    gaps = np.diff(keys, prepend=U(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()
    more = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + more)


def _expand(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(16, -1)
    gaps, counts = (np.ascontiguousarray(x.T).view("<u8").reshape(-1) for x in (raw[:8], raw[8:]))
    return np.cumsum(gaps.astype(U), dtype=U), counts.astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, in as few bytes each as the largest needs."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * k))
    raw = values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)
    return zstandard.ZstdCompressor(level=1).compress(bytes([size]) + np.ascontiguousarray(raw.T).tobytes())


def _from_planes(payload: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T).view(f"<u{raw[0]}").reshape(-1)


def _coded(arrays: list[np.ndarray]) -> bytes:
    parts = [_planes(x) for x in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _decoded(payload: bytes, n: int) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{n}I", payload), 4 * n, []
    for size in sizes:
        out.append(_from_planes(payload[at : at + size]))
        at += size
    return out


def _fractions(per: np.ndarray, num: np.ndarray, den: np.ndarray) -> bytes:
    """Codes of paths (see ``path_codes``). Neighbours often share a context, hence the even
    denominator, and a context often has one symbol only, so the numerator is one less."""
    half = den >> 1
    new = np.ones(len(half), bool)
    new[1:] = half[1:] != half[:-1]
    only = num + 1 == den
    return _coded([per, np.packbits(new), half[new], np.packbits(only), num[~only]])


def _from_fractions(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per, new, half, only, rest = _decoded(payload, 5)
    n = int(per.sum())
    den = 2 * half.astype(np.int64)[np.cumsum(np.unpackbits(new, count=n)) - 1]
    only = np.unpackbits(only, count=n).astype(bool)
    num = den - 1
    num[~only] = rest
    return per, num, den


def _taken(which: np.ndarray, per: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of all entries of the items ``which``; ``per``: entries of each item, ``first``: its first one."""
    n = per[which]
    return np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _merge(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    own = [_expand(p) for p in payloads]
    k = np.concatenate([a for a, _ in own])
    n = np.concatenate([b for _, b in own])
    if not len(k):
        return [a for a, _ in own], k, n
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [a for a, _ in own], k[first], np.add.reduceat(n, first)


class Level:
    """The nodes and branches of the trie at one context length."""

    def __init__(self, branch: np.ndarray, counts: np.ndarray):
        """``branch``: ascending distinct (context, symbol); ``counts``: how often each was seen."""
        self.branch, self.counts = branch, counts
        ctx = branch >> U(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        self.node = np.cumsum(np.concatenate([[0], (ctx[1:] != ctx[:-1]).astype(np.int64)])) if len(ctx) else np.zeros(0, np.int64)
        self.total = np.add.reduceat(counts, first)
        self.distinct = np.add.reduceat((counts > 0).astype(np.int64), first)
        self.n = len(first)


class Short:
    """The trie down to two bytes of context, from ``keys`` (two bytes, symbol) and their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys.astype(U), counts
        ctx, symbol = (keys >> 8).astype(np.int64), (keys & 255).astype(np.int64)
        self.one = np.bincount((ctx >> 8 << 8) | symbol, weights=counts, minlength=1 << 16).astype(np.int64).reshape(256, 256)
        self.zero = self.one.sum(0)
        self.total = np.bincount(ctx, weights=counts, minlength=1 << 16).astype(np.int64)
        self.distinct = np.bincount(ctx, minlength=1 << 16)
        self.below = np.bincount(ctx, weights=self.one[ctx >> 8, symbol], minlength=1 << 16).astype(np.int64)  # what its symbols weigh one byte shorter

    def count(self, ctx_symbol: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(ctx_symbol), np.int64)
        at = np.minimum(np.searchsorted(self.keys, ctx_symbol), len(self.keys) - 1)
        return np.where(self.keys[at] == ctx_symbol, self.counts[at], 0)


def path_codes(keys: np.ndarray, counts: np.ndarray, order: int, short: Short) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probability of each path (order bytes of context, symbol) as a product of fractions:
    how many each path has, their numerators and (even) denominators, path after path.

    ``keys`` ascend and hold all paths of their last three bytes of context; they are taken
    in batches that don't cut such a context.
    """
    third = keys >> U(8 * (order - 2))
    ends = np.concatenate([np.flatnonzero(third[1:] != third[:-1]) + 1, [len(keys)]])
    out, lo = [], 0
    while lo < len(keys):
        hi = int(ends[min(np.searchsorted(ends, lo + BATCH), len(ends) - 1)])
        out.append(_batch_codes(keys[lo:hi], counts[lo:hi], order, short))
        lo = hi
    per, num, den = (np.concatenate(x) for x in zip(*out))
    return per, num, den


def path_costs(per: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """log10 of the products of ``path_codes``."""
    return np.bincount(np.repeat(np.arange(len(per)), per), weights=np.log10(num / den), minlength=len(per))


def _batch_codes(keys: np.ndarray, counts: np.ndarray, order: int, short: Short) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    levels: dict[int, Level] = {}
    where: dict[int, np.ndarray] = {}  # branch of each path at a level
    symbol = keys & U(255)
    for m in range(order, 2, -1):
        branch, where[m] = np.unique(((keys >> U(8 * (order + 1 - m))) << U(8)) | symbol, return_inverse=True)
        levels[m] = Level(branch, np.bincount(where[m], weights=counts, minlength=len(branch)).astype(np.int64))
    codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(len(keys))
    open_ = np.ones(len(keys), bool)
    ex_total = np.zeros(len(keys), np.int64)  # what the symbols of the longer context weigh in this one
    ex_distinct = np.zeros(len(keys), np.int64)

    def step(c, total, distinct):
        """Codes the symbol or an escape in contexts with these counts, less the excluded ones."""
        nonlocal open_
        t, d = total - ex_total, distinct - ex_distinct
        found = open_ & (c > 0)
        miss = open_ & (c == 0) & (t > 0)
        for at, num in ((found, 2 * c - 1), (miss, d)):
            codes.append((rows[at], num[at], 2 * t[at]))
        open_ &= ~found

    for m in range(order, 2, -1):
        lv, at = levels[m], where[m]
        node = lv.node[at]
        step(lv.counts[at], lv.total[node], lv.distinct[node])
        # Exclusion for the next shorter context: its counts of the symbols seen here.
        less = ((lv.branch >> U(16)) << U(8)) | (lv.branch & U(255))
        below = levels[m - 1].counts[np.searchsorted(levels[m - 1].branch, less)] if m > 3 else short.count(less)
        weight = np.bincount(lv.node, weights=np.where(lv.counts > 0, below, 0), minlength=lv.n).astype(np.int64)
        ex_total, ex_distinct = weight[node], lv.distinct[node]
    two, sym = (keys >> U(8 * (order - 1))).astype(np.int64), symbol.astype(np.int64)
    step(short.count((two.astype(U) << U(8)) | symbol), short.total[two], short.distinct[two])
    ex_total, ex_distinct = short.below[two], short.distinct[two]
    one, zero = short.one, short.zero
    byte, seen = two >> 8, one > 0
    step(one[byte, sym], one.sum(1)[byte], seen.sum(1)[byte])
    ex_total, ex_distinct = (seen @ zero)[byte], seen.sum(1)[byte]
    step(zero[sym], np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum()))
    codes.append((rows[open_], np.full(int(open_.sum()), 2), np.full(int(open_.sum()), 2 * max(256 - int((zero > 0).sum()), 1))))
    at, num, den = (np.concatenate(x) for x in zip(*codes))
    by = np.argsort(at, kind="stable")
    return np.bincount(at, minlength=len(keys)), num[by], den[by]


def adaptive_code_length(text: str, order: int = ORDER) -> float:
    """log10 probability of a text coded while its own contexts are learnt, symbol by symbol."""
    raw = b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + b"\n"
    trie: dict[bytes, dict[int, int]] = {}
    past, total = b"\n" * order, 0.0
    for s in raw:
        gone: set[int] = set()
        for m in range(order, -1, -1):
            seen = trie.get(past[len(past) - m :]) if m else trie.get(b"")
            live = {k: v for k, v in seen.items() if k not in gone} if seen else {}
            if not live:
                continue
            weight = 2 * sum(live.values())
            if s in live:
                total += math.log10((2 * live[s] - 1) / weight)
                break
            total += math.log10(len(live) / weight)
            gone |= live.keys()
        else:
            total -= math.log10(256 - len(gone))
        for m in range(order + 1):
            node = trie.setdefault(past[len(past) - m :] if m else b"", {})
            node[s] = node.get(s, 0) + 1
        past = (past + bytes([s]))[1:]
    return total


def score_documents(
    spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", mod: int = 7, held: int = 2, order: int = ORDER,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_symbols) of every document.

    Learns from rows whose crc32(id) mod ``mod`` is not ``held``.
    """
    if not 3 <= order <= 6:
        raise ValueError("order must be 3 to 6")
    import zlib

    scratch = Scratch(spark, "lm")
    chunks = pack(scratch, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), chunk_bytes=CHUNK_BYTES)
    size = chunks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, word_buckets = bucket_count(size // 8), bucket_count(size // 24)

    def read(row) -> Corpus:
        held_out = [i != NULL_ID and zlib.crc32(str(i).encode()) % mod == held for i in map(int, row["ids"])]
        return Corpus(row["ids"], row["lens"], row["blob"], held_out, order)

    def by_context(c: Corpus):
        """Distinct paths in the order they are asked for, with their training counts and buckets."""
        keys, counts = _distinct(c.keys, c.train[c.of])
        b = (mix64(keys >> U(8 * (order - 2))) % U(buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        return keys[by], counts[by], b[by]

    def places(c: Corpus) -> np.ndarray:
        """Where each symbol's path stands in the order of ``by_context``, by one sort instead of a search a symbol."""
        by = np.argsort(c.keys)
        ascending = c.keys[by]
        new = np.ones(len(by), bool)
        new[1:] = ascending[1:] != ascending[:-1]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        dealt = np.argsort(mix64(ascending[new] >> U(8 * (order - 2))) % U(buckets), kind="stable")
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        return place[which]

    def by_word(c: Corpus):
        keys = np.concatenate([c.words >> U(1), np.full(len(c.ids), END_WORD)])
        of = np.concatenate([c.word_of, np.arange(len(c.ids))])
        return keys, of, *_distinct(keys, c.train[of])

    def first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What chunks ask about words (bucket 0 on), and the partition's short contexts (-2) and tokens (-1)."""
        from pyspark import TaskContext

        sums, tokens, part = np.zeros(0, U), 0, TaskContext.get().partitionId()
        counts = np.zeros(0, np.int64)
        for f in frames:
            for _, row in f.iterrows():
                c = read(row)
                k = c.keys[c.train[c.of]]
                k, n = np.unique((k >> U(8 * (order - 1))) << U(8) | (k & U(255)), return_counts=True)
                sums, at = np.unique(np.concatenate([sums, k]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(sums)).astype(np.int64)
                tokens += int((c.n_words[c.train] + 1).sum())
                _, _, keys, n = by_word(c)
                out = [(w, _squeeze(keys[lo:hi], n[lo:hi])) for w, lo, hi in by_bucket(keys << U(1), word_buckets)]
                yield pd.DataFrame({"chunk": row["chunk"], "bucket": [x for x, _ in out], "payload": [y for _, y in out], "n": 0})
        yield pd.DataFrame({"chunk": part, "bucket": [-2, -1], "payload": [_squeeze(sums, counts), None], "n": [0, tokens]})

    kind = "chunk long, bucket int, payload binary, n long"
    asked = scratch.cut(chunks.mapInPandas(tidy(first_pass), kind))
    train_tokens = asked.where("bucket = -1").agg(F.sum("n")).first()[0] or 0
    short = _short_contexts(asked.where("bucket = -2").select(F.col("chunk").alias("part"), "payload"))

    def word_reply(f: pd.DataFrame) -> pd.DataFrame:
        own, keys, counts = _merge(f["payload"].tolist())
        out = pd.DataFrame({"chunk": f["chunk"], "bucket": f["bucket"], "payload": [b"w" + _coded([counts[np.searchsorted(keys, k)]]) for k in own], "n": 0})
        return pd.concat([out, pd.DataFrame({"chunk": [-1], "bucket": [-1], "payload": [None], "n": [int((counts > 0).sum())]})])

    words = scratch.cut(asked.where("bucket >= 0").groupBy("bucket").applyInPandas(word_reply, kind))
    scratch.drop(asked)
    distinct = words.where("chunk < 0").agg(F.sum("n")).first()[0] or 0
    floor = math.log10(train_tokens + distinct + 1)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                keys, counts, b = by_context(read(row))
                cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
                out = [(int(b[lo]), _squeeze(keys[lo:hi], counts[lo:hi])) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()) if hi > lo]
                yield pd.DataFrame({"chunk": row["chunk"], "bucket": [x for x, _ in out], "payload": [y for _, y in out]})

    def reply(f: pd.DataFrame) -> pd.DataFrame:
        own, keys, counts = _merge(f["payload"].tolist())
        per, num, den = path_codes(keys, counts, order, Short(*short))
        first = np.cumsum(per) - per
        out = []
        for k in own:
            which = np.searchsorted(keys, k)
            at = _taken(which, per, first)
            out.append(b"c" + _fractions(per[which], num[at], den[at]))
        return pd.DataFrame({"chunk": f["chunk"], "bucket": f["bucket"], "payload": out})

    kind = "chunk long, bucket int, payload binary"
    answers = chunks.mapInPandas(tidy(ask), kind).groupBy("bucket").applyInPandas(reply, kind)
    answers = answers.unionByName(words.where("chunk >= 0").select("chunk", (F.col("bucket") + buckets).alias("bucket"), "payload"))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                c = read(row)

                costs = np.concatenate([np.zeros(0), *(path_costs(*_from_fractions(p[1:])) for p in row["answers"] if p[:1] == b"c")])
                seen = np.concatenate([np.zeros(0, np.int64), *(_decoded(p[1:], 1)[0] for p in row["answers"] if p[:1] == b"w")])
                n = len(c.ids)
                score = np.bincount(c.of, weights=costs[places(c)], minlength=n)
                keys, of, distinct_words, _ = by_word(c)
                count = seen[np.searchsorted(distinct_words, keys)].astype(float)
                base = np.bincount(of, weights=np.log10(count + 1), minlength=n) - (c.n_words + 1) * floor
                yield pd.DataFrame({
                    "doc_id": pd.array([None if i == NULL_ID else int(i) for i in c.ids], "Int64"), "held_out": ~c.train, "n_tokens": c.n_words + 1,
                    "n_known": np.bincount(of, weights=count > 0, minlength=n).astype(np.int64), "train_tokens": train_tokens,
                    "base_score": base, "score": score, "n_symbols": c.symbols,
                })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long"
    return with_answers(chunks, answers).mapInPandas(tidy(add_up), schema)


def _short_contexts(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the partitions' (two bytes of context, symbol) counts, in rounds."""
    got = summed_in_rounds(parts, [], lambda payloads: _squeeze(*_merge(payloads)[1:])).collect()  # one row
    return _merge([r["payload"] for r in got])[1:] if got else (np.zeros(0, U), np.zeros(0, np.int64))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from six sevenths of them."""
    return score_documents(spark, table(spark, sf_dir, "documents"))
