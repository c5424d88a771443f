"""Language identification: a bidirectional light gated recurrent network over bytes, in numpy.

Each direction keeps h = z*h + (1-z)*c with update gate z and candidate c, both from the byte's own row of
weights and the previous state, through the hard sigmoid clip(a, 0, 1) and the hard tanh clip(a, -1, 1). A position's scores come from the forward state before it and the backward state
after it; a document's probability of a language is the mean over its positions. Training is backpropagation
through time with Adam, on the driver, over a bounded sample: `per_language` documents of each language (those
with the smallest hash of their id) and `pieces` pieces of `piece_chars` characters of each, spread evenly over the
whole text (all of a text that is no longer than these). Prediction reads whole texts: a text is cut into segments of
`SEGMENT` positions, and the segments of many texts advance together, one byte a step. A segment's states are begun
`CONTEXT` bytes outside it on either side (or at the text's own ends), so a position is read with at least so
many bytes before and after it. Rows shorter than others end in padding, at which both states stay as they are, in
training as in prediction.

Defined cases: a null text, or one without any letter, is `und` with score 0; ties go to the language that
sorts first; repeated rows are predicted alike; without any labelled text every prediction is `und`; an empty
table gives no rows; other columns are kept as they are, but in a report those that have the name of an output
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window

from proofset.llm.common import crc_of_id, free_name, quoted, slices, table, utf8

SEGMENT, CONTEXT = 224, 32
PAD, HOLD = 256, 1e4  # not a byte; at it the update gate is held at 1, so states stay, and no gradient passes
UNKNOWN = "und"


@dataclass
class ByteNet:
    """wx: (257, 4H) byte rows, the last of them for padding for [forward z, forward c, backward z, backward c]; u: (2, H, 2H) recurrent
    weights by direction; wo: (2H, L) and bo: (L) for the scores of a position."""

    langs: list[str]
    wx: np.ndarray
    u: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    @property
    def h(self) -> int:
        return self.u.shape[1]

    def log_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (L, T, B), not normalised, of segments x (T, B) of byte values. The two directions advance in
        one state (B, 2H), with one block-diagonal matrix for the gates and one for the candidates."""
        steps, width = x.shape
        h, wide = self.h, 2 * self.h
        uz, uc = np.zeros((wide, wide), np.float32), np.zeros((wide, wide), np.float32)
        rows = np.zeros((2, 2, PAD + 1, wide), np.float32)  # [gate or candidate][direction]
        for d in range(2):
            own = slice(d * h, (d + 1) * h)
            uz[own, own], uc[own, own] = self.u[d][:, :h], self.u[d][:, h:]
            rows[0, d][:, own], rows[1, d][:, own] = self.wx[:, 2 * d * h : (2 * d + 1) * h], self.wx[:, (2 * d + 1) * h : 2 * (d + 1) * h]
        states = np.zeros((steps, width, wide), np.float32)
        s, z, c, more = np.zeros((width, wide), np.float32), *(np.empty((width, wide), np.float32) for _ in range(3))
        for t in range(steps):
            ahead, behind = x[t], x[steps - 1 - t]
            for a, u, r, low in ((z, uz, rows[0], 0.0), (c, uc, rows[1], -1.0)):
                np.matmul(s, u, out=a)
                a += np.take(r[0], ahead, axis=0, out=more, mode="clip")
                a += np.take(r[1], behind, axis=0, out=more, mode="clip")
                np.clip(a, np.float32(low), np.float32(1), out=a)
            s -= c
            s *= z
            s += c
            states[t] = s
        forward = states.reshape(-1, wide)[:, :h] @ self.wo[:h]
        backward = states[::-1].reshape(-1, wide)[:, h:] @ self.wo[h:]
        forward += backward
        forward += self.bo
        return np.ascontiguousarray(forward.T).reshape(-1, steps, width)


def softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    return a


def segmented(texts: list[bytes], segment: int, context: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as rows (B, T) of `segment` positions with up to `context` bytes of the text before and after them,
    then padding; document of each row; where its own positions begin, and how many they are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // segment)
    doc = np.repeat(np.arange(len(texts)), rows)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * segment  # in its text
    low, high = np.maximum(0, at - context), np.minimum(sizes[doc], at + segment + context)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    width = int((high - low).max(initial=0))
    out = np.full((len(doc), width), PAD, np.uint16)
    inside = np.arange(width) < (high - low)[:, None]
    out[inside] = flat[((np.cumsum(sizes) - sizes)[doc] + low)[:, None].repeat(width, 1)[inside] + np.broadcast_to(np.arange(width), inside.shape)[inside]]
    return out, doc, at - low, np.minimum(segment, sizes[doc] - at)


def train(texts: list[bytes], labels: list[str], hidden: int = 8, segment: int = 48, epochs: int = 4, short: float = 0.25, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Backpropagation through time, cross-entropy at every position, Adam. Padding is no position. A share `short`
    of the rows is cut to 8 to 24 positions, so that brief texts are learned too."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet(langs, (rng.normal(0, 0.3, (PAD + 1, 4 * hidden)) + 0.5 * (np.arange(4 * hidden) // hidden % 2 == 0)).astype(np.float32), rng.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(np.float32), rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    net.wx[PAD] = np.where(np.arange(4 * hidden) // hidden % 2 == 0, HOLD, 0)
    rows, doc, _, _ = segmented(texts, segment)
    y = np.array([langs.index(v) for v in labels])[doc]
    cut = np.where(rng.random(len(rows)) < short, rng.integers(8, 25, len(rows)), segment)
    rows[np.arange(rows.shape[1]) >= cut[:, None]] = PAD
    weights = [net.wx, net.u, net.wo, net.bo]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = _gradients(net, rows[pick].T, y[pick])
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for i, (w, g) in enumerate(zip(weights, grads, strict=True)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                w -= lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    steps, width = x.shape
    h = net.h
    states, gates, cands = [np.zeros((2, steps + 1, width, h), np.float32)], np.empty((2, steps, width, h), np.float32), np.empty((2, steps, width, h), np.float32)
    s = states[0]
    seq = [x, x[::-1]]
    for d in range(2):
        for t in range(steps):
            a = net.wx[seq[d][t], 2 * d * h : 2 * (d + 1) * h] + s[d, t] @ net.u[d]
            z, c = np.clip(a[:, :h], 0, 1), np.clip(a[:, h:], -1, 1)
            gates[d, t], cands[d, t] = z, c
            s[d, t + 1] = z * s[d, t] + (1 - z) * c
    both = np.concatenate([s[0, 1:], s[1, 1:][::-1]], -1)
    p = softmax(both @ net.wo + net.bo)
    p[:, np.arange(width), y] -= 1
    real = x != PAD
    p *= (real / max(1, real.sum()))[..., None]
    g_wo = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[-1])
    g_bo = p.sum((0, 1))
    back = p @ net.wo.T
    g_wx, g_u = np.zeros_like(net.wx), np.zeros_like(net.u)
    for d in range(2):
        out = back[..., :h] if d == 0 else back[::-1, :, h:]
        carry, moved = np.zeros((width, h), np.float32), np.empty((steps, width, 2 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            carry = carry + out[t]
            z, c, before = gates[d, t], cands[d, t], s[d, t]
            da = np.concatenate([carry * (before - c) * ((z > 0) & (z < 1)), carry * (1 - z) * (np.abs(c) < 1)], -1)
            moved[t] = da
            g_u[d] += before.T @ da
            carry = carry * z + da @ net.u[d].T
        byte = seq[d].ravel()
        order = np.argsort(byte, kind="stable")
        first = np.flatnonzero(np.diff(byte[order], prepend=-1))
        g_wx[byte[order][first], 2 * d * h : 2 * (d + 1) * h] = np.add.reduceat(moved.reshape(-1, 2 * h)[order], first)
    return [g_wx, g_u, g_wo, g_bo]


def pooled(net: ByteNet, texts: list[bytes], most_rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean probability of each language over all positions, and how many positions each language
    labels (it has the largest score there)."""
    langs = len(net.langs)
    total, votes = np.zeros((len(texts), langs)), np.zeros((len(texts), langs), np.int64)
    rows, doc, first, length = segmented(texts, SEGMENT, CONTEXT)
    used = (rows != PAD).sum(1)
    order = np.argsort(used, kind="stable")  # rows of like lengths go together
    for at in range(0, len(rows), most_rows):
        pick = order[at : at + most_rows]
        own, steps = doc[pick], int(used[pick[-1]])
        scores = net.log_scores(np.ascontiguousarray(rows[pick, :steps].T).astype(np.intp))
        place = np.arange(steps)[:, None] - first[pick]
        inside = (place >= 0) & (place < length[pick])
        top, best = scores[0].copy(), np.zeros(scores.shape[1:], np.int32)
        for k in range(1, langs):
            better = scores[k] > top
            best[better] = k
            np.maximum(top, scores[k], out=top)
        best[~inside] = -1
        scores -= top
        np.exp(scores, out=scores)
        scores *= inside / scores.sum(0)
        np.add.at(total, own, scores.sum(1, dtype=np.float64).T)
        np.add.at(votes, own, np.stack([(best == k).sum(0) for k in range(langs)], -1))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None], votes


def training_sample(docs: DataFrame, allowed: Column, doc_id: str, text: str, lang: str, per_language: int, pieces: int, piece_chars: int, salts: int = 64) -> tuple[list[bytes], list[str]]:
    """Texts and labels for training: the ids are chosen on narrow rows, then only their texts are fetched. The
    last choice reads at most salts x per_language rows of a language, however many tasks there are."""
    labelled = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = labelled.select(F.col(doc_id), F.col(lang).alias("_lang"), F.xxhash64(doc_id).alias("_hash"))
    for keys in (["_lang", F.pmod("_hash", F.lit(salts))], ["_lang"]):  # a language may hold most rows: first the best of each part of it, then the best of those
        ids = ids.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", doc_id))).filter(F.col("_rank") <= per_language).drop("_rank")
    ids = ids.select(doc_id)  # an id may stand several times; the join below only asks whether it is there
    size = F.char_length(text)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(F.col(text), (F.floor(i * (size - piece_chars) / max(1, pieces - 1)) + 1).cast("int"), F.lit(piece_chars)))
    spread = F.when(size <= pieces * piece_chars, F.array(F.col(text))).otherwise(cuts)
    rows = labelled.join(F.broadcast(ids), doc_id, "left_semi").select(F.col(lang).alias("l"), F.xxhash64(doc_id, text).alias("o"), spread.alias("t")).groupBy("l", "o").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r.o, r.l, r.t))
    return [x.encode() for r in rows for x in r.t], [r.l for r in rows for _ in r.t]


def fit(docs: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, pieces: int = 8, piece_chars: int = 48, **options) -> ByteNet | None:
    texts, labels = training_sample(docs, allowed, doc_id, text, lang, per_language, pieces, piece_chars)
    return train(texts, labels, **options) if any(texts) else None


OUTPUTS = {"lang_pred": pa.string(), "score": pa.float64(), "positions": pa.list_(pa.int64())}


def labelled_batches(net: ByteNet | None, text: str, letters: str, most_bytes: int = 2 << 20):
    """mapInArrow function: batches with lang_pred, score and positions (by language, in order of names)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, most_bytes):
            texts = [t if t and ok else b"" for t, ok in zip(utf8(b.column(text)), b.column(letters).to_pylist(), strict=True)]
            n = len(texts)
            if net is None or not any(texts):
                best, score, votes = [UNKNOWN] * n, [0.0] * n, [[]] * n
            else:
                mean, counts = pooled(net, texts)
                top = mean.argmax(-1)
                best = [net.langs[k] if t else UNKNOWN for k, t in zip(top.tolist(), texts, strict=True)]
                score = [min(1.0, float(mean[i, k])) if texts[i] else 0.0 for i, k in enumerate(top.tolist())]
                votes = counts.tolist()
            keep = [c for c in b.schema.names if c != letters and c.lower() not in OUTPUTS]
            yield pa.record_batch([*b.select(keep).columns, pa.array(best), pa.array(score, pa.float64()), pa.array(votes, OUTPUTS["positions"])], names=[*keep, *OUTPUTS])

    return predict


def has_letter(text: Column) -> Column:
    """Never null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score and positions, which replace columns of these names. Whether a text has a letter is
    asked of the JVM."""
    letters = free_name(docs.columns, "letters")
    marked = docs.withColumn(letters, has_letter(F.col(text)))
    schema = StructType([f for f in docs.schema.fields if f.name.lower() not in OUTPUTS])
    schema = schema.add("lang_pred", "string").add("score", "double").add("positions", ArrayType(LongType()))
    return marked.mapInArrow(labelled_batches(net, text, letters), schema)


def keep_identified(docs: DataFrame, net: ByteNet | None, least_score: float, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter and, where there is a network, a language with at least least_score
    of the pooled probability. Same columns, whatever their names."""
    if net is None:
        return docs.filter(has_letter(F.col(text)))
    cols = docs.columns
    whole = docs.select(F.col(text).alias("body"), F.struct(*[quoted(c).alias(c) for c in cols]).alias("row"))
    kept = identify(whole, net, "body").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return kept.select(*[F.col("row")[c].alias(c) for c in cols])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    net = fit(docs, ~held)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score", "positions")
