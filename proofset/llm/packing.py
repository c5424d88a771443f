"""Lexical retrieval packing: a sharded BM25 inverted index fills each window with its seed's neighbours.

Documents are tokenised once and written; document frequencies, document count and mean length are taken over
all of them and only then broadcast (one number per vocabulary entry). A shard is a bounded number of tokens,
dealt by content: a tree of splits in two, grown on a bounded sample of the documents' BM25 directions, has cells
of neighbours, whose true sizes over all documents are then counted; neighbouring small cells share a shard, and
a cell that the sample could not split is dealt over several by a hash. Neighbours beyond a shard are not found
(the README says how many are within). One task indexes a shard and packs it: an open window
takes its seed (the rest of the document that the last window cut), then the seed's best unused neighbours, in
order of BM25 over all its terms; when none shares a term with it any more, the next unused document in order of
ids and then that one's neighbours. Windows are filled to the last
token. What is left at the end of a shard is cut into sequences whose lengths are powers of two, so nothing is
padded at all.

Defined cases: a null text is an empty one, and has the end token only; a null doc_id is an id like any other
and sorts first; repeated rows are packed each by itself; ties of the score go to the earlier document; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import block_count, slices, table, text_bytes, utf8, written

_TAILED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")  # a word and ASCII punctuation, but no apostrophe, after it
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 3, np.int8)  # kinds of bytes, lower-cased: white space as bytes.split() sees it, a-z (and à-ÿ), ASCII punctuation but no apostrophe, others
_KIND[list(b" \t\n\r\x0b\x0c")] = 0
_KIND[97:123] = 1
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs for times and divided by
_CUTS = np.zeros(16, np.int8)  # by the kinds of a byte and the byte before it: 1 where a unit starts, 2 where one ends, 3 both
_CUTS[[4 * k for k in (1, 2, 3)]] = 1
_CUTS[[1, 2, 3]] = 2
_CUTS[[4 * 2 + 1, 4 * 1 + 2]] = 3  # the tokenizer's own rule always splits between a letter and such punctuation
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = pa.schema([(n.split()[0], pa.int64()) for n in PIECES_DDL.split(", ")])


class WordTable:
    """An open-addressing table from words of at most 8 * width bytes to their numbers, all in numpy. The packed
    bytes are compared in full, so unequal words never meet."""

    def __init__(self, width: int, most: int) -> None:
        self.bits = max(10, (2 * most - 1).bit_length())
        self.keys = np.zeros((1 << self.bits, width), np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _MIX
        for k in range(1, keys.shape[1]):
            h = (h ^ (h >> np.uint64(29)) ^ keys[:, k]) * _MIX
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not held."""
        at, out, todo = self._slots(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            held = self.number[slot]
            same = held >= 0
            for k in range(keys.shape[1]):
                same &= self.keys[slot, k] == keys[todo, k]
            out[todo[same]] = held[same]
            todo = todo[(held >= 0) & ~same]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Distinct words that are not held."""
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            free = self.number[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.number[at[put]] = keys[put], number[put]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose vocabulary never joins across white space, with the ids of
    words remembered. A word's ids do not depend on its neighbours: the normaliser drops white space, and
    splitting and merging happen inside words. Many texts are cut into words at once, words are looked up by
    their packed bytes, and only new ones are encoded. A word of letters alone is one unit and ends in an id whose
    vocabulary entry carries the end-of-word mark, so many new words are encoded in one call and cut there.
    Texts that hold '<|' (special tokens) are encoded as a whole. Once `most_words` are remembered, further words
    are forgotten after their call; what came first, and so is mostly what is common, stays."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, file: str, most_words: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most_words = Tokenizer.from_file(file), most_words
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for entry, i in self.tok.get_vocab().items():
            self.ends[i] = entry.endswith("</w>")
        self.tables = {16: WordTable(2, most_words), 48: WordTable(6, most_words // 8)}
        self.room = {16: most_words, 48: most_words // 8}
        self.first, self.count, self.words = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    @classmethod
    def of(cls, file: str, most_words: int = 900_000) -> WordTokenizer:
        """One for each worker process, which keeps its memory of words from task to task."""
        if file not in cls._made:
            cls._made[file] = cls(file, most_words)
        return cls._made[file]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Put the ids of new words behind the others; returns the first one's number."""
        n, total, before = len(sizes), len(ids), self.words
        while before + n > len(self.first):
            self.first, self.count = np.concatenate((self.first, np.zeros_like(self.first))), np.concatenate((self.count, np.zeros_like(self.count)))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = ids
        self.first[before : before + n] = self.used + np.cumsum(sizes) - sizes
        self.count[before : before + n] = sizes
        self.words, self.used = before + n, self.used + total
        return before

    def _letters(self, words: list[bytes], per_call: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, one after another, and how many each has."""
        calls = [b" ".join(words[k : k + per_call]).decode() for k in range(0, len(words), per_call)]
        ids = np.array([i for e in self.tok.encode_batch_fast(calls, add_special_tokens=False) for i in e.ids], np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            return ids, np.diff(cuts, prepend=0)
        each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]  # letters that the tokenizer splits after all
        return np.concatenate([ids[:0], *each]), np.array([len(e) for e in each], np.int64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of any kind: what is letters and then ASCII punctuation is put together from both."""
        letters: dict[bytes, int] = {}
        other: dict[bytes, int] = {}
        parts: list[tuple[int, ...]] = []
        for w in words:
            stem, tail = w, b""
            if (m := _TAILED.fullmatch(w)) is not None:
                stem, tail = m[1], m[2]
            if not stem.decode().isalpha():
                parts.append((-1 - other.setdefault(w, len(other)),))
            else:
                parts.append((letters.setdefault(stem, len(letters)), *((-1 - other.setdefault(tail, len(other)),) if tail else ())))
        ids, sizes = self._letters(list(letters))
        known = np.split(ids, np.cumsum(sizes)[:-1])
        rest = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
        each = [known[k] if k >= 0 else rest[-1 - k] for own in parts for k in own]
        return np.concatenate([ids[:0], *each]), np.array([sum(len(known[k] if k >= 0 else rest[-1 - k]) for k in own) for own in parts], np.int64)

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and where each text ends. With end_id, it follows each."""
        words_before, used_before = self.words, self.used
        whole = {i: t for i, t in enumerate(texts) if b"<|" in t}
        flat = b"\n".join([b"" if i in whole else t for i, t in enumerate(texts)]).lower() + b" " * 49
        raw = np.frombuffer(flat, np.uint8)
        kind = _KIND[raw]
        pair = np.flatnonzero((raw[:-1] == 0xC3) & _LATIN[raw[1:]])  # UTF-8 of a letter À to ÿ
        kind[pair] = kind[pair + 1] = 1
        turn = kind[1:] * 4 + kind[:-1]
        cut = _CUTS[turn]
        start = np.flatnonzero(np.concatenate(([kind[0] > 0], (cut & 1) > 0)))
        end = np.flatnonzero((cut & 2) > 0) + 1
        size = end - start
        number = np.full(len(start), -1, np.int32)
        odd = size > 48
        if (zero := raw == 0).any():  # a zero byte packs like none
            seen = np.concatenate(([0], np.cumsum(zero)))
            odd |= seen[end] > seen[start]
        eight = np.ndarray((len(raw) - 7,), "<u8", flat, strides=(1,))
        fresh: list[tuple[np.ndarray, np.ndarray | None, int]] = []  # new words: their numbers' place, keys, class
        low, plain = 0, None
        for most, table in self.tables.items():
            at = np.flatnonzero((size > low) & (size <= most) & ~odd)
            low = most
            keys = np.empty((len(at), most // 8), np.uint64)
            for k in range(most // 8):
                keys[:, k] = eight[np.minimum(start[at] + 8 * k, len(eight) - 1)] & _LOW_BYTES[np.clip(size[at] - 8 * k, 0, 8)]
            got = table.find(keys)
            number[at] = got
            at, keys = at[got < 0], keys[got < 0]
            if len(at):
                order = np.lexsort(keys.T[::-1])
                new = np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(1)))
                one, which = order[new], np.empty(len(at), np.int64)
                which[order] = np.cumsum(new) - 1
                if plain is None:
                    plain = np.concatenate(([0], np.cumsum(kind != 1)))
                pure = plain[end[at[one]]] == plain[start[at[one]]]
                one, rank = np.concatenate((one[pure], one[~pure])), np.argsort(np.argsort(~pure, kind="stable"))  # letters alone come first
                names = [flat[a:b] for a, b in zip(start[at[one]].tolist(), end[at[one]].tolist(), strict=True)]
                base = self._keep(*self._letters(names[: pure.sum()]))
                self._keep(*self._encoded(names[pure.sum() :]))
                number[at] = base + rank[which]
                fresh.append((base + np.arange(len(one)), keys[one], most))
        if odd.any():
            names: dict[bytes, int] = {}
            at = np.flatnonzero(odd)
            which = [names.setdefault(flat[start[i] : end[i]], len(names)) for i in at.tolist()]
            number[at] = self._keep(*self._encoded(list(names))) + np.array(which)
        bounds = np.cumsum(np.fromiter((0 if i in whole else len(t) for i, t in enumerate(texts)), np.int64, len(texts)) + 1)  # where the next text starts
        upto = np.searchsorted(start, bounds)
        extra_at, extra = [], []
        for i, t in whole.items():
            extra_at.append(upto[i])
            own = self._plain(t.decode())
            extra.append(self._keep(own, np.array([len(own)])))
        order_at = np.array(extra_at, np.int64)
        if end_id is not None:
            mark = self._keep(np.array([end_id], np.uint32), np.array([1]))
            order_at = np.concatenate((order_at, upto))
            extra += [mark] * len(texts)
        if len(extra):  # whole texts come before the end of theirs, as np.insert keeps the order of equal places
            by = np.lexsort((np.arange(len(extra)), np.concatenate((np.array(list(whole), np.int64), np.arange(len(texts)))) if end_id is not None else np.array(list(whole), np.int64)))
            number = np.insert(number, order_at[by], np.array(extra, np.int32)[by])
            steps = np.ones(len(texts), np.int64) * (end_id is not None)
            steps[list(whole)] += 1
            upto = upto + np.cumsum(steps)
        count = self.count[number].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[number] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        text_ends = np.concatenate(([0], ends))[upto]
        self._remember(fresh, words_before, used_before)
        return ids, text_ends

    def _remember(self, fresh: list, words_before: int, used_before: int) -> None:
        """Put new words into the tables, as far as there is room, and forget the others."""
        last = words_before
        for numbers, keys, most in fresh:
            if (room := self.room[most]) > 0:
                self.tables[most].add(keys[:room], numbers[:room])
                self.room[most] -= min(room, len(keys))
                last = int(numbers[:room][-1]) + 1
            if room < len(keys):  # those of the next table lie behind what is forgotten
                break
        self.words, self.used = last, int(self.first[last - 1] + self.count[last - 1]) if last > words_before else used_before


def tokenised(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian; 16-bit where the vocabulary allows it). Ends with end_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.of(tokenizer_file)
        kind = _id_type(tok)
        for b in slices(batches, "text", 2 << 20):
            ids, ends = tok.encode(utf8(b.column("text")), end_id)
            flat, offsets = ids.astype(kind), (np.concatenate(([0], ends)) * int(kind[2])).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])], names=["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id long, ids binary")


def _id_type(tok: WordTokenizer) -> str:
    return "<u2" if tok.tok.get_vocab_size() <= 1 << 16 else "<u4"


def flat_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and where each row's end."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // int(kind[2])
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.cumsum(sizes)


def corpus_statistics(tokens: DataFrame, width: int, vocab: int) -> tuple[np.ndarray, int, int]:
    """Document frequency by id, documents and tokens, over all documents. The result has one row per
    vocabulary entry at most, whatever the corpus."""
    kind = f"<u{width}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(vocab, np.int64), 0, 0
        for b in slices(batches, "ids", 1 << 20):
            ids, ends = flat_ids(b.column("ids"), kind)
            for at in range(0, len(ends), 1 << 16):  # a document's place and an id make a key of 32 bits
                part = np.diff(ends[at : at + (1 << 16)], prepend=ends[at - 1] if at else 0)
                own = ids[ends[at] - part[0] : ends[min(len(ends), at + (1 << 16)) - 1]]
                wide = np.uint32 if vocab <= 1 << 16 else np.uint64
                key = np.repeat(np.arange(len(part), dtype=wide) << wide(16 if wide is np.uint32 else 32), part) | own
                key.sort()
                first = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))] & wide((1 << (16 if wide is np.uint32 else 32)) - 1)
                df += np.bincount(first.astype(np.int64), minlength=vocab)
            docs, total = docs + len(ends), total + len(ids)
        at = np.flatnonzero(df)
        yield pa.record_batch({"id": pa.array(np.concatenate((at, [-1, -2]))), "n": pa.array(np.concatenate((df[at], [docs, total])))})

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r.id: r.n for r in rows}
    df = np.zeros(vocab, np.int64)
    for k, n in found.items():
        if k >= 0:
            df[k] = n
    return df, found.get(-1, 0), found.get(-2, 0)


DIMENSIONS = 64


@lru_cache(maxsize=2)
def directions(vocab: int) -> np.ndarray:
    """A fixed random direction for each vocabulary entry; every worker makes the same ones for itself."""
    return np.random.default_rng(11).normal(0, 1, (vocab, DIMENSIONS)).astype(np.float32)


def content_vector(ids: np.ndarray, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """A document's BM25 weights as one direction (of length 1, or 0): documents that share strong terms are near."""
    terms, tf = np.unique(ids, return_counts=True)
    v = bm25(idf[terms], tf.astype(np.float32), np.float32(len(ids)), mean_length) @ directions(len(idf))[terms]
    return v / max(1e-9, float(np.linalg.norm(v)))


class Cells:
    """A tree of splits in two by content. Cells are numbered from left to right, so that near numbers are near in
    the tree. Grown on a sample until a cell's share of the text is within `most`, or its documents are all alike."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, most: float, rounds: int = 8) -> None:
        self.splits: list[np.ndarray] = []  # the two centres of each split
        self.below: list[list[int]] = []  # for each of the two sides, a later split or -1 - cell
        self.cells, todo = 0, [(np.arange(len(vectors)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            halves = None
            if sizes[own].sum() > most and len(own) > 1:
                halves = self._halves(vectors[own], sizes[own], rounds)
            if halves is None:
                here, self.cells = -1 - self.cells, self.cells + 1
            else:
                here = len(self.splits)
                self.splits.append(halves[0])
                self.below.append([0, 0])
                todo += [(own[halves[1]], here, 1), (own[~halves[1]], here, 0)]
            if parent >= 0:
                self.below[parent][side] = here

    @staticmethod
    def _halves(x: np.ndarray, sizes: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Centres and the side of each row (spherical 2-means, begun at a far pair); None if nothing splits."""
        a = x[np.argmin(x @ x.mean(0))]
        centres = np.stack([a, x[np.argmin(x @ a)]])
        for _ in range(rounds):
            right = x @ (centres[1] - centres[0]) > 0
            if right.all() or not right.any():
                return None
            centres = np.stack([x[~right].mean(0), x[right].mean(0)])
            centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
        right = x @ (centres[1] - centres[0]) > 0
        return None if right.all() or not right.any() else (centres, right)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(np.arange(len(x)), 0)] if self.splits else []
        while todo:
            own, node = todo.pop()
            right = x[own] @ (self.splits[node][1] - self.splits[node][0]) > 0
            for rows, child in ((own[~right], self.below[node][0]), (own[right], self.below[node][1])):
                if child < 0:
                    out[rows] = -1 - child
                elif len(rows):
                    todo.append((rows, child))
        return out


def shards_of_cells(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard, and number of shards, of each cell: neighbouring cells share one up to `most`; a cell beyond it
    (documents that the sample could not tell apart) is dealt over several by a hash."""
    first, parts, shard, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[c], parts[c] = shard, block_count(n, most)
        held += n
        if parts[c] > 1:
            shard, held = shard + int(parts[c]), 0
    return first, parts


def dealt(tokens: DataFrame, kind: str, idf, mean_length: float, n_docs: int, n_tokens: int, most: int, sample_docs: int = 20_000) -> DataFrame:
    """tokens with their shard, of `most` tokens at most (a longer document, or repeated rows, may exceed it). Only
    the vectors of a bounded sample and one size for each cell come to the driver."""
    spark = tokens.sparkSession
    mark = F.xxhash64("doc_id", "ids")

    def vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.frombuffer(x, kind) for x in b.column("ids").to_pylist()]
        return np.stack([content_vector(x, idf.value, mean_length) for x in ids]), np.array([len(x) for x in ids], np.int64)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", 2 << 20):
            x, sizes = vectors(b)
            yield pa.record_batch([b.column("mark"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(sizes)], names=["mark", "v", "n"])

    sample = []
    if n_tokens > most:
        span = 1 << 30
        chosen = tokens.select("ids", mark.alias("mark")).filter(F.pmod("mark", F.lit(span)) < math.ceil(span * min(1.0, sample_docs / n_docs)))
        sample = chosen.mapInArrow(sampled, "mark long, v binary, n long").groupBy("mark").agg(F.min("v").alias("v"), F.sum("n").alias("n")).orderBy("mark").collect()
    x = np.array([np.frombuffer(r.v, np.float32) for r in sample], np.float32).reshape(-1, DIMENSIONS)
    sizes = np.array([r.n for r in sample], np.float64)
    tree = Cells(x, sizes * (n_tokens / max(1.0, sizes.sum())), most)
    cells = spark.sparkContext.broadcast(tree)  # two centres for each cell

    if tree.cells == 1:
        first, parts = shards_of_cells(np.array([n_tokens], np.int64), most)
        return tokens.select("doc_id", (F.pmod(mark, F.lit(int(parts[0])))).cast("int").alias("shard"), "ids")

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", 2 << 20):
            cell = cells.value.of(vectors(b)[0]).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.array(cell), b.column("ids")], names=["doc_id", "cell", "ids"])

    # written, because the sizes of all cells decide about shards: directions are taken once for each document
    rows = written(tokens.select("doc_id", "ids").mapInArrow(celled, "doc_id long, cell int, ids binary"), "token-cells")
    found = np.zeros(tree.cells, np.int64)
    for r in rows.groupBy("cell").agg(F.sum(F.octet_length("ids")).alias("n")).collect():  # one row a cell
        found[r.cell] = r.n // int(kind[2])
    first, parts = shards_of_cells(found, most)
    of_cell = lambda x: F.element_at(F.array(*[F.lit(int(v)) for v in x]), F.col("cell") + 1)
    return rows.select("doc_id", (of_cell(first) + F.pmod(mark, of_cell(parts))).cast("int").alias("shard"), "ids")


def bm25(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    return (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(1.0, mean_length)))).astype(np.float32)


class ShardIndex:
    """BM25 postings of a shard's documents, in numpy: for each term, documents and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        n, lengths = len(docs), np.array([len(d) for d in docs], np.int64)
        wide = np.uint32 if n <= 1 << 16 and len(idf) <= 1 << 16 else np.uint64
        shift = wide(16 if wide is np.uint32 else 32)
        key = np.concatenate(docs).astype(wide) << shift if n else np.zeros(0, wide)
        key |= np.repeat(np.arange(n, dtype=wide), lengths)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        term, doc = (key >> shift).astype(np.int64), (key & ((wide(1) << shift) - wide(1))).astype(np.int32)
        weight = bm25(idf[term], tf, lengths[doc], mean_length)
        term, doc, weight = term[weight > 0], doc[weight > 0], weight[weight > 0]
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))
        self.doc, self.weight, self.n = doc, weight, n
        order = np.argsort(doc, kind="stable")
        self.query_at, self.query = np.searchsorted(doc[order], np.arange(n + 1)), term[order]
        common = np.flatnonzero(np.diff(self.starts) * 4 > n)  # terms of many documents: their weights as whole rows
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for r, t in zip(self.rows, common.tolist(), strict=True):
            r[doc[self.starts[t] : self.starts[t + 1]]] = weight[self.starts[t] : self.starts[t + 1]]

    def neighbours(self, seed: int, unused: np.ndarray, least: int = 32) -> Iterator[int]:
        """All unused documents that share a term with the seed, by BM25 over all its terms, best first, ties to
        the earlier one. They are put in order as far as they are asked for."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        common = self.row[terms] >= 0
        spans = list(zip(self.starts[terms[~common]].tolist(), self.starts[terms[~common] + 1].tolist(), strict=True))
        docs = np.concatenate([self.doc[a:b] for a, b in spans] or [self.doc[:0]])
        weights = np.concatenate([self.weight[a:b] for a, b in spans] or [self.weight[:0]])
        if not common.any() and len(docs) * 8 < self.n:
            near, docs = np.unique(docs, return_inverse=True)
            s = np.bincount(docs, weights, len(near)).astype(np.float32)
        else:
            s = np.bincount(docs, weights, self.n).astype(np.float32)
            for r in self.row[terms[common]].tolist():
                s += self.rows[r]
            near = np.flatnonzero(s)
            s = s[near]
        near, s = near[unused[near]], s[unused[near]]
        while len(near):
            best = s >= np.partition(s, len(s) - least)[len(s) - least] if least < len(s) else np.ones(len(s), bool)
            yield from near[best][np.argsort(-s[best], kind="stable")].tolist()
            near, s, least = near[~best], s[~best], 4 * least


def pack_shard(docs: list[np.ndarray], index: ShardIndex, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); sequences count from 0."""
    unused = np.ones(len(docs), bool)
    left, order, sequence, used = len(docs), 0, 0, 0
    open_pieces: list[tuple[int, int, int]] = []
    queue: Iterator[int] = iter(())
    rest: tuple[int, int] | None = None
    while left or rest:
        asks = used == 0
        if rest is None:
            doc = next(queue, -1)
            if doc < 0:  # no neighbour is left: the next document brings its own
                asks = True
                while not unused[order]:
                    order += 1
                doc = order
            unused[doc], left, start = False, left - 1, 0
        else:
            (doc, start), rest = rest, None
        n = min(len(docs[doc]) - start, window - used)
        open_pieces.append((doc, start, n))
        used += n
        if start + n < len(docs[doc]):
            rest = (doc, start + n)
        if used == window:
            offset = 0
            for d, s, m in open_pieces:
                yield d, s, m, sequence, offset
                offset += m
            sequence, used, open_pieces, queue = sequence + 1, 0, [], iter(())
        elif asks and left:
            queue = index.neighbours(doc, unused)
    while used:  # the last, partly filled window: sequences of 2**k tokens need no padding
        size = room = 1 << (used.bit_length() - 1)
        while room:
            d, s, m = open_pieces[0]
            n = min(m, room)
            yield d, s, n, sequence, size - room
            room -= n
            open_pieces[0] = (d, s + n, m - n)
            if m == n:
                open_pieces.pop(0)
        used, sequence = used - size, sequence + 1


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = 4096, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 10 << 20, with_ids: bool = False) -> DataFrame:
    """The pieces (PIECES_DDL; with_ids adds the token ids of each). shard_bytes: text in a shard, about."""
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer_file, end_id, doc_id, text), "tokens")
    tok = WordTokenizer.of(tokenizer_file)
    kind, vocab = _id_type(tok), tok.tok.get_vocab_size()
    df, n_docs, n_tokens = corpus_statistics(tokens, int(kind[2]), vocab)
    weights = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    weights[end_id] = 0  # every document has the end token: it makes no neighbours
    idf = spark.sparkContext.broadcast(weights)  # one float per vocabulary entry
    mean_length = n_tokens / max(1, n_docs)
    shards = block_count(text_bytes(docs, text)[1], shard_bytes)
    most = max(1, n_tokens if shards == 1 else math.ceil(1.5 * n_tokens / shards))  # cells fill shards by about two thirds

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        shard, names = group.column("shard")[0].as_py(), group.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, kind) for x in group.column("ids").to_pylist()]
        rows, held = [], []
        for d, start, n, sequence, offset in pack_shard(ids, ShardIndex(ids, idf.value, mean_length), window):
            piece = ids[d][start : start + n].astype("<u4")
            rows.append((names[d], start, n, zlib.crc32(piece), len(ids[d]), (shard << 32) + sequence, offset))
            if with_ids:
                held.append(piece)
        out = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=PIECES)
        if with_ids:
            flat = pa.array(np.concatenate(held).astype(np.int32))
            out = out.append_column("ids", pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)), flat))
        return out

    return dealt(tokens, kind, idf, mean_length, n_docs, n_tokens, most).groupBy("shard").applyInArrow(packed, PIECES_DDL + (", ids array<int>" if with_ids else ""))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
