"""Language-model scoring: prediction by partial matching over bytes, beside a smoothed word unigram.

The model is a trie of byte contexts up to `order` bytes, with the counts of the bytes that follow them in all
training texts. A byte unseen in a context escapes to the next shorter one (escape estimate: distinct followers
against their occurrences, method C); the bytes that the longer context has seen are excluded there, so no
probability is spent twice; after the empty context, all bytes left are alike. Every text ends in a zero byte,
which is predicted too.

Nothing global is broadcast, as the trie grows with the corpus. Texts are dealt into blocks of bounded size. A
block reports its distinct words and (order+1)-byte strings with their training counts, dealt by hash into parts,
one packed row for each part. A part sums its rows over all blocks; its strings go to the bucket of their context,
which turns each into the logarithm of its last byte's probability. Values come back to the parts and from there
to the blocks in the order in which both sides list their strings, so that no string is sent again. A task holds a
block, a part or a bucket, whatever the corpus.

Defined cases: a null text is an empty one (one token, the end); repeated rows are scored each by itself and
count each in training; a null doc_id is not held out; without training texts every count is 0 and bytes
are uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import block_count, crc_of_id, table, text_bytes, utf8, written

END = b""  # the end token; words are never empty
COUNTS_DDL = "block int, part int, words binary, word_n binary, grams binary, gram_n binary"
SUMS_DDL = "part int, bucket int, grams binary, gram_n binary, vocabulary long, train_tokens long"
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, word_sum double, score double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The (order+1)-byte strings of texts, each text after `order` zero bytes and before one. Strings are
    numbered level by level: a string is the number of its first part and one more byte, so that plain counting
    tables of the strings that occur replace sorting."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        pad = bytes(order)
        flat = np.frombuffer(pad + pad.join(t + b"\0" for t in texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.cumsum(sizes + order) - sizes - order  # where each text's first string begins
        self.sizes = sizes
        n = len(flat) - order
        seen = np.flatnonzero(np.bincount(flat, minlength=256))
        code = np.zeros(256, np.int64)
        code[seen] = np.arange(len(seen))
        coded = code[flat].astype(np.int32)
        rank, value = coded[: n if order else None], seen.astype(np.uint64)
        for j in range(1, order + 1):
            key = rank.astype(np.int64) * len(seen) + coded[j : j + n]
            there = np.zeros(len(value) * len(seen), bool)
            there[key] = True
            at = np.flatnonzero(there)
            number = np.cumsum(there, dtype=np.int32)
            rank = number[key] - 1
            value = (value[at // len(seen)] << np.uint64(8)) | seen[at % len(seen)].astype(np.uint64)
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, self.first, 1)
        np.add.at(inside, self.first + sizes, -1)
        self.inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        self.rank, self.value = rank, value

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the strings that occur at a predicted byte, ascending, and their occurrences in training texts."""
        weight = np.repeat(train, self.sizes)
        used = self.rank[self.inside]
        total = np.bincount(used, minlength=len(self.value))
        trained = np.bincount(used[weight], minlength=len(self.value))
        at = np.flatnonzero(total)
        return at, trained[at]

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value given for each string."""
        per = value[self.rank[self.inside]]
        return np.add.reduceat(per, np.cumsum(self.sizes) - self.sizes) if len(self.sizes) else np.zeros(0)


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: the high bytes of small numbers lie together and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def dealt(key: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each 64-bit key."""
    return (((key * _MIX) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """By the two bytes before the last, which keeps every context of two bytes and more in one place."""
    return dealt((gram >> np.uint64(8)) & np.uint64(0xFFFF), buckets)


def in_parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by part, and the parts in it."""
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def word_parts(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    return in_parts(dealt(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), parts))


def gram_parts(gram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return in_parts(dealt(gram, parts))


class PartSums:
    """The rows of one part, summed over blocks."""

    def __init__(self, rows: pa.Table) -> None:
        self.words: list[list[bytes]] = []
        self.total: Counter[bytes] = Counter()
        for names, n in zip(rows.column("words").to_pylist(), rows.column("word_n").to_pylist(), strict=True):
            own = names.split(b" ") if n else []  # the end token is an empty word
            self.words.append(own)
            for w, c in zip(own, unplaned(n).tolist(), strict=True):
                self.total[w] += c
        steps = [unplaned(g) for g in rows.column("grams").to_pylist()]
        flat = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps])
        self.gram, self.at = np.unique(flat, return_inverse=True)
        self.ends = np.cumsum([len(x) for x in steps])
        self.n = np.bincount(self.at, np.concatenate([unplaned(n) for n in rows.column("gram_n").to_pylist()]), len(self.gram))


def log_probabilities(gram: np.ndarray, n: np.ndarray, order: int, low: np.ndarray) -> np.ndarray:
    """log10 probability of each string's last byte after the bytes before it.

    gram: distinct strings that together hold every string of each of their contexts of 2 bytes and more; n:
    training counts, 0 for strings to be scored only; low: (256, 256) training counts of byte pairs, for the
    contexts of one and no byte."""
    one = low.sum(0)
    distinct = int((one > 0).sum())
    follow, kinds = low.sum(1), (low > 0).sum(1)
    known = low > 0
    lost_n, lost_d = (known * one).sum(1), kinds  # what the context of one byte excludes after escape to none
    down = _blend(np.tile(one, 256), one.sum(), distinct, np.repeat(lost_n, 256), np.repeat(lost_d, 256), np.tile(base_escape(one), 256))
    # from here on: for strings of m+1 bytes, the value after their context of m bytes, given the suffixes' values
    counts = {order + 1: (gram, n)}
    for m in range(order, 2, -1):
        g, c = counts[m + 1]
        u, inv = np.unique(g & np.uint64((1 << 8 * m) - 1), return_inverse=True)
        counts[m] = (u, np.bincount(inv, c, len(u)))
    counts[2] = (np.arange(65536, dtype=np.uint64), low.ravel().astype(np.float64))
    below_kinds = {2: (np.arange(256, dtype=np.uint64), kinds.astype(np.float64))}
    escaped = {2: down}  # value of a string of 2 bytes given that its context of 1 byte escaped
    total = {2: follow.astype(np.float64)}
    value = _top(low.ravel(), np.repeat(follow, 256), np.repeat(kinds, 256), down)
    for m in range(2, order + 1):
        g, c = counts[m + 1]
        c = c.astype(np.float64)
        ctx, own = np.unique(g >> np.uint64(8), return_inverse=True)
        cn, cd = np.bincount(own, c, len(ctx)), np.bincount(own, c > 0, len(ctx))
        s, sc = counts[m]
        at = np.searchsorted(s, g & np.uint64((1 << 8 * m) - 1))
        under = sc[at]
        lost_n, lost_d = np.bincount(own, under * (c > 0), len(ctx)), cd
        short, kinds_below = below_kinds[m]
        up = np.searchsorted(short, ctx & np.uint64((1 << 8 * (m - 1)) - 1))
        down = _blend(under, total[m][up][own], kinds_below[up][own], lost_n[own], lost_d[own], escaped[m][at])
        value = _top(c, cn[own], cd[own], down)
        below_kinds[m + 1], total[m + 1], escaped[m + 1] = (ctx, cd), cn, down
    return value


def base_escape(one: np.ndarray) -> np.ndarray:
    """Value of a byte after the empty context has escaped: all bytes it has not seen are alike."""
    left = max(1, 256 - int((one > 0).sum()))
    return np.full(256, -math.log10(left))


def _blend(c, total, kinds, lost_n, lost_d, further) -> np.ndarray:
    """A context's value of a byte, less what the longer context excludes; further: its value after escape."""
    n, d = np.maximum(0.0, total - lost_n), np.maximum(0.0, kinds - lost_d)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log10(np.where(c > 0, c, 1.0) / np.maximum(1.0, n + d))
        escape = np.where(d > 0, np.log10(np.where(d > 0, d, 1.0) / np.maximum(1.0, n + d)), 0.0)
    return np.where(c > 0, seen, escape + further)


def _top(c, total, kinds, further) -> np.ndarray:
    """A context's value of a byte with nothing excluded."""
    return _blend(c, total, kinds, 0.0, 0.0, further)


def score_documents(docs: DataFrame, train: str, order: int = 4, block_bytes: int = 7 << 20, model_buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text, and `train`,
    a boolean column that says whether a text is learned from)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(train), F.lit(True)).alias("train"))
    blocks = block_count(text_bytes(rows)[1], block_bytes)
    parts, buckets = max(8, blocks // 2), model_buckets or max(8, blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def count(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        texts, trained = utf8(t.column("text")), t.column("train").to_numpy().astype(bool)
        words, others = Counter({END: 0}), set()
        for text, own in zip(texts, trained.tolist(), strict=True):
            found = tokens_of(text)
            if own:
                words.update(found)
                words[END] += 1
            else:
                others.update(found)
        names = sorted(others.union(words))
        word_n = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
        own = Grams(texts, order)
        at, n = own.counts(trained)
        gram = own.value[at]
        w_order, w_part = word_parts(names, parts)
        g_order, g_part = gram_parts(gram, parts)
        out = []
        for p in np.union1d(w_part, g_part).tolist():
            w, g = (o[slice(*np.searchsorted(k, (p, p + 1)))] for o, k in ((w_order, w_part), (g_order, g_part)))
            out.append((block, p, b" ".join([names[i] for i in w.tolist()]), planes(word_n[w]), planes(np.diff(gram[g], prepend=np.uint64(0))), planes(n[g])))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "part", "words", "word_n", "grams", "gram_n"])

    counts = written(rows.groupBy("block").applyInArrow(count, COUNTS_DDL), "lm-counts")

    def add_up(t: pa.Table) -> pa.Table:
        part, own = t.column("part")[0].as_py(), PartSums(t)
        by, bucket = in_parts(bucket_of(own.gram, buckets))
        out = [(part, -1, b"", b"", sum(c > 0 for c in own.total.values()), own.total.total())]
        for k in np.unique(bucket).tolist():
            at = by[slice(*np.searchsorted(bucket, (k, k + 1)))]
            out.append((part, k, planes(np.diff(own.gram[at], prepend=np.uint64(0))), planes(own.n[at]), None, None))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "bucket", "grams", "gram_n", "vocabulary", "train_tokens"])

    sums = written(counts.groupBy("part").applyInArrow(add_up, SUMS_DDL), "lm-sums")
    size = sums.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("vocabulary"), F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("train_tokens"))

    def price(t: pa.Table, model: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "totals": pa.array([], pa.binary()), "log10s": pa.array([], pa.binary())})
        own, value = PartSums(t), np.zeros(0)
        if model.num_rows:
            by, _ = in_parts(bucket_of(own.gram, buckets))
            value = np.empty(len(own.gram))
            value[by] = np.frombuffer(b"".join(model.sort_by("bucket").column("log10s").to_pylist()))
        log10s = [value[at].tobytes() for at in np.split(own.at, own.ends[:-1])]
        totals = [planes(np.fromiter(map(own.total.__getitem__, w), np.int64, len(w))) for w in own.words]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "totals": pa.array(totals, pa.binary()), "log10s": pa.array(log10s, pa.binary())})

    model = byte_model(sums.filter("bucket >= 0").select("part", "bucket", "grams", "gram_n"), order)
    priced = counts.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(price, "block int, part int, totals binary, log10s binary")

    def score(t: pa.Table, entries: pa.Table) -> pa.Table:
        texts, trained = utf8(t.column("text")), t.column("train").to_numpy().astype(bool)
        entries = entries.sort_by("part")
        tokens = [tokens_of(text) for text in texts]
        names = sorted({END}.union(*tokens))
        total = np.empty(len(names))
        total[word_parts(names, parts)[0]] = np.concatenate([unplaned(x) for x in entries.column("totals").to_pylist()])
        logs = dict(zip(names, np.log10(total + 0.5).tolist(), strict=True))
        unseen = math.log10(0.5)
        n_tokens, n_known, sums = [], [], []
        for found in tokens:
            got = list(map(logs.__getitem__, found))
            got.append(logs[END])
            n_tokens.append(len(got))
            n_known.append(len(got) - got.count(unseen))
            sums.append(math.fsum(got))
        own = Grams(texts, order)
        at, _ = own.counts(trained)
        value = np.zeros(len(own.value))
        value[at[gram_parts(own.value[at], parts)[0]]] = np.frombuffer(b"".join(entries.column("log10s").to_pylist()))
        return pa.table({"doc_id": t.column("doc_id"), "held_out": pa.compute.invert(t.column("train")), "n_tokens": n_tokens, "n_known": n_known, "word_sum": sums, "score": own.sums(value)})

    scored = rows.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(score, SCORES_DDL)
    with_size = scored.crossJoin(F.broadcast(size))  # one row
    base = F.col("word_sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("vocabulary") + 1))
    return with_size.select("doc_id", "held_out", "n_tokens", "n_known", F.col("train_tokens").cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def byte_model(sums: DataFrame, order: int) -> DataFrame:
    """part, bucket, log10s: for every string of `sums` (part, bucket, grams, gram_n), log10 of its last byte's
    probability, in the same order. The counts of byte pairs (65,536 at most) are all that goes to every task."""

    def last_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(65536)
        for b in batches:
            for g, n in zip(b.column("grams").to_pylist(), b.column("gram_n").to_pylist(), strict=True):
                last = np.cumsum(unplaned(g), dtype=np.uint64) & np.uint64(0xFFFF)
                low += np.bincount(last.astype(np.int64), unplaned(n), 65536)
        at = np.flatnonzero(low)
        yield pa.record_batch({"pair": at, "n": low[at]})

    low = np.zeros(65536)
    for r in sums.select("grams", "gram_n").mapInArrow(last_pairs, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        low[r.pair] = r.n
    shared = sums.sparkSession.sparkContext.broadcast(low.reshape(256, 256))

    def values(t: pa.Table) -> pa.Table:
        grams = [np.cumsum(unplaned(g), dtype=np.uint64) for g in t.column("grams").to_pylist()]
        n = np.concatenate([unplaned(x) for x in t.column("gram_n").to_pylist()]).astype(np.int64)
        value = log_probabilities(np.concatenate(grams), n, order, shared.value)
        pieces = np.split(value, np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"part": t.column("part"), "bucket": t.column("bucket"), "log10s": pa.array([v.tobytes() for v in pieces], pa.binary())})

    return sums.groupBy("bucket").applyInArrow(values, "part int, bucket int, log10s binary")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 1, F.lit(True)))
    return score_documents(docs, "train")
