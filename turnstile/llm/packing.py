"""Vector bin packing of tokenised examples into training sequences.

Every example has a demand vector (tokens, segments, loss-bearing tokens), a sequence has
the same three limits. The open sequence takes the example whose demand has the largest
dot product with what the sequence has left (each dimension divided by its limit) among
those that fit. When none fits, an example is cut to fill it if cutting is allowed. Plain
documents bear loss on every token; ``pack_conversations`` counts the turns of some roles,
and any table may bring its own column of loss-bearing tokens. The examples packed together are those of one batch of an input partition: packing needs no
shuffle and no other state, so a lost executor repeats its partitions and nothing else.

Cases: an example of no tokens gives no piece; a null text is empty; equal rows are
examples of their own; an example longer than a sequence is cut, or, with ``cut=False``,
refused with ValueError; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, named, table, tidy


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Piece:
    item: int
    start: int
    length: int
    sequence: int
    offset: int


def _bin_piece(left: int, most: int) -> int:
    """The largest power of two up to ``left`` and ``most``."""
    return 1 << (min(left, most).bit_length() - 1)


def pack(lengths, loss=None, limits: Limits = Limits(), cut: bool = True, pow2_tail: bool = True) -> list[Piece]:
    """Pieces of every item, packed into sequences numbered from 0.

    ``loss``: loss-bearing tokens of each item, taken to lie evenly in it; all by default.
    ``pow2_tail``: a sequence that can't be filled ends in sequences of powers of two,
    which need no padding.
    """
    n = np.asarray(lengths, dtype=np.int64)
    loss = n if loss is None else np.asarray(loss, dtype=np.int64)
    rate = np.where(n > 0, loss / np.maximum(n, 1), 0.0)
    if not cut and (n.max(initial=0) > limits.tokens or loss.max(initial=0) > limits.loss_tokens):
        raise ValueError("an example exceeds the limits and cutting is off")
    out: list[Piece] = []
    seq = 0
    todo: list[tuple[int, int]] = []  # (item, start) with less than a sequence left
    for i, size in enumerate(n.tolist()):
        start, full = 0, limits.tokens
        if cut and rate[i] * limits.tokens > limits.loss_tokens:
            full = max(1, int(limits.loss_tokens / rate[i]))
        while cut and size - start >= full:
            out.append(Piece(i, start, full, seq, 0))
            start, seq = start + full, seq + 1
        if size > start:
            todo.append((i, start))
    if not todo:
        return out
    item = np.array([i for i, _ in todo])
    begin = np.array([s for _, s in todo])
    left = n[item] - begin
    bear = np.ceil(rate[item] * left).astype(np.int64) if cut else loss[item]
    # A class of equal demands is one candidate, so a choice scans classes, not items.
    demand, cls = np.unique(np.stack([left, bear], 1), axis=0, return_inverse=True)
    stacks: list[list[int]] = [[] for _ in demand]
    for k in range(len(item) - 1, -1, -1):
        stacks[cls.reshape(-1)[k]].append(k)
    alive = np.array([len(s) for s in stacks])
    t_cap, s_cap, l_cap = limits.tokens, limits.segments, limits.loss_tokens
    d = np.stack([demand[:, 0] / t_cap, np.full(len(demand), 1.0 / s_cap), demand[:, 1] / max(l_cap, 1)], 1)
    rest, extra = len(item), []  # extra: tails of cut items, taken first
    while rest or extra:
        tok, seg, los, at = t_cap, s_cap, l_cap, 0
        pieces = []
        while tok > 0 and seg > 0 and (rest or extra):
            if extra:
                k, s = extra.pop()
                take = min(int(n[item[k]] - s), tok, _loss_room(los, rate[item[k]]))
                if take <= 0:
                    extra.append((k, s))
                    break
                if s + take < n[item[k]]:
                    extra.append((k, s + take))
            else:
                fits = (alive > 0) & (demand[:, 0] <= tok) & (demand[:, 1] <= los)
                if fits.any():
                    score = np.where(fits, d @ np.array([tok / t_cap, seg / s_cap, los / max(l_cap, 1)]), -1.0)
                    c = int(score.argmax())
                elif cut:
                    c = int(np.flatnonzero(alive > 0)[-1])
                else:
                    break
                k = stacks[c].pop()
                alive[c] -= 1
                rest -= 1
                s = int(begin[k])
                take = min(int(n[item[k]] - s), tok, _loss_room(los, rate[item[k]]) if cut else tok)
                if take <= 0:
                    extra.append((k, s))
                    break
                if s + take < n[item[k]]:
                    extra.append((k, s + take))
            pieces.append((int(item[k]), s, take, at))
            at, tok, seg, los = at + take, tok - take, seg - 1, los - int(np.ceil(rate[item[k]] * take))
        if cut and pow2_tail and at & (at - 1) and at < t_cap:
            seq = _split(pieces, at, seq, out)
        else:
            out += [Piece(i, s, m, seq, o) for i, s, m, o in pieces]
            seq += 1
    return out


def _loss_room(left: int, rate: float) -> int:
    return int(left / rate) if rate > 0 else 1 << 40


def _split(pieces: list[tuple], total: int, seq: int, out: list[Piece]) -> int:
    """Deals a short sequence over sequences whose lengths are the powers of two in ``total``."""
    room, at = _bin_piece(total, total), 0
    for i, s, m, _ in pieces:
        while m:
            take = min(m, room - at)
            out.append(Piece(i, s, take, seq, at))
            s, m, at = s + take, m - take, at + take
            if at == room:
                total, seq, at = total - room, seq + 1, 0
                room = _bin_piece(total, total) if total else 0
    return seq


class WordTokenizer:
    """Ids of whole texts by a tokenizer file, fast for one whose tokens never cross white space.

    Texts of natural language repeat their words, so ids are kept by word and by letter
    run in two bounded tables (a full table starts anew; results don't depend on it).
    Words that aren't plain printable Latin letters go through the library itself.
    """

    RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MOST = 600_000

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        # Only a file of exactly these rules is read word by word; any other by the library, text by text.
        split, level = {"type": "Split", "pattern": {"Regex": self.RUNS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "use_regex": False, "add_prefix_space": False}
        clean = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.by_word = (
            (parts.get("normalizer") or {}).get("normalizers") == clean and len(steps) == 2 and steps[0] == split
            and level.items() <= steps[1].items() and parts.get("post_processor") is None and parts.get("truncation") is None
        )
        self.runs = regex.compile(self.RUNS)
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tok.get_added_tokens_decoder().values()))) or r"(?!)")
        # Bytes as the printable characters of byte-level models, by the published rule.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.chars = str.maketrans({**{chr(b): chr(b) for b in plain}, **{chr(b): chr(256 + i) for i, b in enumerate(other)}})
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        got = self.pieces.get(run)
        if got is None:
            if len(self.pieces) >= self.MOST:
                self.pieces.clear()
            got = np.array([t.id for t in self.model.tokenize(run.encode().decode("latin1").translate(self.chars))], "<u4").tobytes()
            self.pieces[run] = got
        return got

    def _word(self, word: bytes) -> bytes:
        w = word.decode()
        if w.isascii() or max(w) < "ɐ":
            if w.isprintable() and "ʰ" > max(w):
                return b"".join(map(self._run, self.runs.findall(unicodedata.normalize("NFC", w).lower())))
        return np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or self.special.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.encode().split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) >= self.MOST:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = np.array([2], "<u4").tobytes()
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    """One tokenizer a worker process; ``path`` defaults to the installed public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _packed(rows: DataFrame, read, limits: Limits, batch_tokens: int) -> DataFrame:
    """Pieces of ``rows``; ``read`` gives (id, ids as bytes, loss-bearing tokens or None for all) of each row of a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 40
        ids, blobs, loss, size = [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal seq
            lengths = [len(b) // 4 for b in blobs]
            pieces = pack(lengths, [n if x is None else min(max(x, 0), n) for x, n in zip(loss, lengths)], limits=limits)
            crc = [zlib.crc32(memoryview(blobs[p.item])[4 * p.start : 4 * (p.start + p.length)]) for p in pieces]
            out = pd.DataFrame({
                "doc_id": pd.array([ids[p.item] for p in pieces], "Int64"), "start": [p.start for p in pieces],
                "length": [p.length for p in pieces], "ids_crc32": crc, "doc_tokens": [lengths[p.item] for p in pieces],
                "sequence_id": [seq + p.sequence for p in pieces], "offset": [p.offset for p in pieces],
            })
            seq += 1 + max((p.sequence for p in pieces), default=-1)
            return out

        for f in frames:
            for i, b, x in read(f):
                ids.append(None if pd.isna(i) else int(i))
                blobs.append(b)
                loss.append(x)
                size += len(b) // 4
                if size >= batch_tokens:
                    yield close()
                    ids, blobs, loss, size = [], [], [], 0
        if ids:
            yield close()

    return rows.mapInPandas(tidy(run), PIECES)


def pack_documents(
    spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", loss: str | None = None, limits: Limits = Limits(),
    batch_tokens: int = 2_000_000, tokenizer_path: str | None = None,
) -> DataFrame:
    """Pieces of all documents. A sequence's id is its partition's number in the upper and
    its own in the lower 40 bits. A batch closes at ``batch_tokens`` tokens, so memory
    follows the batch and the longest document. ``loss``: a column with the number of a
    document's tokens that bear loss, all of them where it is null or not given.
    """
    batch_rows(spark)

    def read(f: pd.DataFrame):
        tok = tokenizer(tokenizer_path)
        for i, t, x in zip(f["doc_id"].array, f["text"].array, f["loss"].array):
            yield i, (tok.ids(t) if isinstance(t, str) else b"") + END, None if pd.isna(x) else int(x)

    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"), (named(loss) if loss else F.lit(None)).cast("long").alias("loss"))
    return _packed(rows, read, limits, batch_tokens)


def pack_conversations(
    spark: SparkSession, turns: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text", bearing=("assistant",),
    limits: Limits = Limits(loss_tokens=2048), batch_tokens: int = 2_000_000, tokenizer_path: str | None = None,
) -> DataFrame:
    """Pieces of all conversations (``doc_id`` is the conversation's): its turns in order, each with an
    end id; the tokens of the roles ``bearing`` bear loss."""
    batch_rows(spark)
    rows = turns.select(named(conv_id).cast("long").alias("doc_id"), F.struct(named(turn).alias("n"), named(role).alias("role"), named(text).alias("text")).alias("t"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def read(f: pd.DataFrame):
        tok = tokenizer(tokenizer_path)
        for i, ts in zip(f["doc_id"].array, f["turns"]):
            parts = [(t["role"], (tok.ids(t["text"]) if isinstance(t["text"], str) else b"") + END) for t in ts]
            yield i, b"".join(b for _, b in parts), sum(len(b) // 4 for r, b in parts if r in bearing)

    return _packed(rows, read, limits, batch_tokens)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack_documents(spark, table(spark, sf_dir, "documents"))
