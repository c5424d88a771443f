"""Benchmark decontamination with a generalised suffix automaton over words.

All test items of a group are inserted in one automaton whose size is linear in their words. A document's words
stream through it; the state tells the longest suffix that is part of any item. Where it reaches `window` words
(or a whole item that is shorter), those words are hit. Items are dealt into groups of at most `group_bytes` of
text, so that an automaton is bounded whatever the benchmark's size. With one group, documents pass it and that is
all. With several, each group is a pass of its own that reports only the texts it hits (a task holds one automaton);
the reports are put together by the text's hash of 128 bits, and joined to the documents.

Defined cases: a null text has no words; an item without words matches nothing; equal items are all named; a
null item id is an id of its own, listed as null; repeated documents are rows of their own; empty tables give no rows
or no hits; other columns are ignored (report) or kept as they are (removal), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import block_count, free_name, slices, table, text_bytes, text_key, utf8, written

WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
TO_WORDS = bytes(c if c in WORD_BYTES else 32 for c in bytes(range(256)).lower())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised over items [(id, words)]. State 0 is the root."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.holders: list[set[str | None]] = [set()]
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        brief: list[tuple[str, list[int]]] = []
        for name, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
                self._insert(name, ids)
                self.least = min(self.least, len(ids))
                if len(ids) < window:
                    brief.append((name, ids))
        for name, ids in brief:  # by their final states: later insertions may have split earlier ones
            state = 0
            for w in ids:
                state = self.next[state][w]
            self.short.setdefault(state, []).append((len(ids), name))
        self._memo: dict[int, tuple[frozenset[str], list[tuple[int, str]]]] = {}

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.holders.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that end p + w; q keeps the longer ones."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.holders[c] = set(self.holders[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def _insert(self, name: str, ids: list[int]) -> None:
        last = 0
        for w in ids:
            last = self._extend(last, w)
        state = 0
        for w in ids:  # the states of the item's prefixes, as they are now; every suffix hangs on their links
            state = v = self.next[state][w]
            while v > 0 and name not in self.holders[v]:
                self.holders[v].add(name)
                v = self.link[v]

    def _at(self, v: int, n: int) -> int:
        """The state of the last n words of a state's longest string."""
        while self.length[self.link[v]] >= n if v else False:
            v = self.link[v]
        return v

    def found(self, v: int) -> tuple[frozenset[str], list[tuple[int, str]]]:
        """Items that hold the last `window` words of state v; short items that are suffixes of it."""
        if v not in self._memo:
            at = self._at(v, self.window)
            wide = frozenset(self.holders[at]) if self.length[v] >= self.window else frozenset()
            short, u = [], v
            while u > 0:
                short += self.short.get(u, ())
                u = self.link[u]
            self._memo[v] = (wide, short)
        return self._memo[v]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (start, end), merged; items with an occurring window."""
        n = len(words)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if n < self.least:
            return spans, items
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        runs = known.reshape(-1, 2)
        for a, b in runs[(runs[:, 1] - runs[:, 0]) >= self.least].tolist():
            self._run(ids[a:b].tolist(), a, spans, items)
        return spans, items

    def _run(self, ids: list[int], base: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        v = size = 0
        for i, w in enumerate(ids):
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = nxt[v].get(w)
            if to is None:
                size = 0
                continue
            v, size = to, size + 1
            if size >= least:
                wide, short = self.found(v)
                hit = 0
                if size >= window:
                    hit = size
                    items |= wide
                for n, name in short:
                    if n <= size:
                        hit = max(hit, n)
                        items.add(name)
                if hit:
                    start, end = base + i + 1 - hit, base + i + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))


def item_groups(benchmark: DataFrame, item_id: str, text: str, group_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in groups of about group_bytes; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = block_count(text_bytes(rows)[1], group_bytes)
    for g in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == g)
        yield [(r.id, words_of(r.text.encode())) for r in part.collect()]


def as_names(items: Iterable[str | None]) -> list[str | None]:
    """Distinct ids in the order of strings; a null id stands where its name would."""
    return sorted(set(items), key=lambda x: ("null" if x is None else x, x is None))


FOUND = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64())


def _matched(docs: DataFrame, benchmark: DataFrame, text: str, window: int, item_id: str, item_text: str, group_bytes: int, finish: Callable[[pa.RecordBatch, tuple], pa.RecordBatch], ddl: str) -> DataFrame:
    """What `finish` makes of the batches of docs and, for each row, its flat starts and ends of hit words (merged), the
    items found, and its number of words. ddl: its columns."""
    groups = item_groups(benchmark, item_id, item_text, group_bytes)
    spark = docs.sparkSession
    first = next(groups)
    second = next(groups, None)
    if second is None:
        model = spark.sparkContext.broadcast(SuffixAutomaton(first, window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text, 4 << 20):
                found = []
                for body in utf8(b.column(text)):
                    words = words_of(body)
                    hit, named = model.value.scan(words)
                    found.append(([x for s in hit for x in s], as_names(named), len(words)))
                yield finish(b, tuple(zip(*found, strict=True)))

        return docs.mapInArrow(scan, ddl)

    bodies = docs.select(*[h.alias(c) for h, c in zip(text_key(F.col(text)), "ab", strict=True)], F.col(text).alias("body")).filter("body is not null")
    hits = None
    for group in chain([first, second], groups):
        model = spark.sparkContext.broadcast(SuffixAutomaton(group, window))

        def report(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "body", 4 << 20):
                rows = [model.value.scan(words_of(body)) for body in utf8(b.column("body"))]
                at = [i for i, (hit, _) in enumerate(rows) if hit]
                spans, items = [[x for s in rows[i][0] for x in s] for i in at], [as_names(rows[i][1]) for i in at]
                yield pa.record_batch([b.column("a").take(pa.array(at, pa.int64())), b.column("b").take(pa.array(at, pa.int64())), pa.array(spans, FOUND[0]), pa.array(items, FOUND[1])], names=["a", "b", "spans", "items"])

        own = bodies.mapInArrow(report, "a long, b long, spans array<int>, items array<string>").groupBy("a", "b").agg(F.first(F.struct("spans", "items")).alias("hit"))
        hits = own if hits is None else hits.unionByName(own)
    hits = written(hits, "benchmark-hits").groupBy("a", "b").agg(F.collect_list("hit").alias("hits"))  # one for each group at most
    a, b, key = (free_name(docs.columns, n) for n in ("text_a", "text_b", "hits"))
    hits = hits.select(F.col("a").alias(a), F.col("b").alias(b), F.col("hits").alias(key))
    marked = docs.withColumns(dict(zip((a, b), text_key(F.col(text)), strict=True))).join(hits, [a, b], "left").drop(a, b)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            found = []
            for body, own in zip(utf8(batch.column(text)), batch.column(key).to_pylist(), strict=True):
                hit = merged([s for h in own or () for s in zip(h["spans"][::2], h["spans"][1::2], strict=True)])
                found.append(([x for s in hit for x in s], as_names(i for h in own or () for i in h["items"]), len(words_of(body))))
            yield finish(batch.select([c for c in batch.schema.names if c != key]), tuple(zip(*found, strict=True)))

    return marked.mapInArrow(combine, ddl)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10, item_id: str = "item_id", item_text: str = "text", group_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (array, sorted as strings), spans (flat starts and ends of hit words)."""

    def report(b: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        spans, items, words = found
        return pa.record_batch([b.column("doc_id"), pa.array(words, pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array(items, FOUND[1]), pa.array(spans, FOUND[0])], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _matched(rows, benchmark, "text", window, item_id, item_text, group_bytes, report, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<int>")
    return found.withColumnRenamed("doc_id", doc_id)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, most_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text", group_bytes: int = 1 << 20) -> DataFrame:
    """docs with the hit spans cut out of their texts; a document is dropped when more than most_coverage of
    its words are hit. Same columns; n_chars, where there is one, follows the text."""
    names, cols = docs.columns, [f"c{k}" for k in range(len(docs.columns))]  # Spark's Python steps take no dots in names
    rows, body_at = docs.toDF(*cols), names.index(text)
    chars_at = names.index("n_chars") if "n_chars" in names else None
    text = cols[body_at]

    def cut(b: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        spans, _, words = found
        share = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        keep = [i for i in range(b.num_rows) if share[i] <= most_coverage * words[i]]
        out = b.select(cols)
        hit = [i for i in keep if share[i]]
        if hit:
            body = b.column(text).to_pylist()
            for i in hit:
                body[i] = cut_words(body[i], spans[i])
            out = out.set_column(body_at, text, pa.array(body, out.schema.field(body_at).type))
            if chars_at is not None:
                n = out.column(chars_at).to_pylist()
                for i in hit:
                    n[i] = len(body[i])
                out = out.set_column(chars_at, cols[chars_at], pa.array(n, out.schema.field(chars_at).type))
        return out if len(keep) == b.num_rows else out.take(pa.array(keep, pa.int64()))

    return _matched(rows, benchmark, text, window, item_id, item_text, group_bytes, cut, rows.schema).toDF(*names)


def cut_words(text: str, spans: list[int]) -> str:
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        parts.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",", "null").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

