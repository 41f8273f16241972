"""Evaluation texts in training text: pigeonhole pieces, exact hits by automaton, verified with Myers bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import words
from wakeline.storage import keep

_OUT = pa.schema([("doc_id", pa.int64()), ("eval_id", pa.int64()), ("distance", pa.int32()), ("spans", pa.int32()), ("item_spans", pa.int32()), ("first_word", pa.int32())])


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """n words cut into errors + 1 pieces of nearly equal length, as (start, end)."""
    cut = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cut, cut[1:], strict=False))


def myers(pattern: list[str], text: list[str], errors: int) -> tuple[int, int]:
    """(least edit distance of pattern to any stretch of text, its end); errors + 1 and -1 where none is within errors.

    Myers' bit-parallel column: vp and vn hold where a column rises and falls, one addition moves on by a symbol.
    """
    m, peq = len(pattern), {}
    for i, s in enumerate(pattern):
        peq[s] = peq.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, errors + 1, -1
    for j, s in enumerate(text):
        eq = peq.get(s, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), d0 & hp
        if score < best:
            best, end = score, j
    return best, end


class _Matcher:
    """The items' spans behind an Aho-Corasick automaton of their pieces."""

    def __init__(self, items: list[tuple[int, list[str]]], span: int, errors: int):
        import ahocorasick

        self.errors, self.span, self.items = errors, span, items
        found: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, ws) in enumerate(items):
            for i in range(len(ws) - span + 1):
                for a, b in pieces(span, errors):
                    found.setdefault(" " + " ".join(ws[i + a : i + b]) + " ", []).append((k, i, a))
        self.auto = ahocorasick.Automaton()
        for text, places in found.items():
            self.auto.add_word(text, (len(text), places))
        if found:
            self.auto.make_automaton()
        self.any = bool(found)

    def spans(self, text: str | None) -> dict[int, dict[int, tuple[int, int]]]:
        """item -> span start -> (distance, first word in the text)."""
        ws = words(text)
        if not self.any or len(ws) < self.span - self.errors:
            return {}
        joined, out, tried = " " + " ".join(ws) + " ", {}, set()
        at = word = 0
        for end, (size, places) in self.auto.iter(joined):
            start = end - size + 1
            if start >= at:
                word += joined.count(" ", at, start)
            else:
                word -= joined.count(" ", start, at)
            at = start
            for k, i, a in places:
                if (k, i, word - a) in tried:
                    continue
                tried.add((k, i, word - a))
                lo = max(0, word - a - self.errors)
                d, to = myers(self.items[k][1][i : i + self.span], ws[lo : word - a + self.span + self.errors], self.errors)
                if d <= self.errors:
                    first = max(0, lo + to - self.span + 1)
                    known = out.setdefault(k, {})
                    known[i] = min(known.get(i, (d, first)), (d, first))
        return out


_HITS = "doc_id bigint, eval_id bigint, span int, distance int, first_word int"


def _hash(words_: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words_)) - (1 << 63)


def _span_pieces(rows: DataFrame, span: int, errors: int) -> DataFrame:
    """(h, i, s, a, words): the pieces of every span of the items (i, p): hash, item, where the span begins, where the piece begins in it, the span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(p)
                for s in range(len(ws) - span + 1):
                    out += [(_hash(ws[s + x : s + y]), i, s, x, " ".join(ws[s : s + span])) for x, y in pieces(span, errors)]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["h", "i", "s", "a", "words"])

    return rows.mapInArrow(cut, "h bigint, i bigint, s int, a int, words string")


def _joined_hits(docs: DataFrame, found: DataFrame, span: int, errors: int, bits: int = 28) -> DataFrame:
    """_HITS of documents (doc_id, text) by a join on hashes of pieces. A bitmap of 2**bits places, set where some piece's hash falls, is all that is
    broadcast, however many items there are; the corpus is scanned once, and only stretches that pass the bitmap are shuffled, with the words around them."""
    low = (1 << (bits - 10)) - 1  # 1,024 stretches of the bitmap

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - bits)
            for c in np.unique(at >> np.uint64(bits - 10)):
                part = own.setdefault(int(c), np.zeros((low + 1) // 8, np.uint8))
                x = (at[at >> np.uint64(bits - 10) == c] & np.uint64(low)).astype(np.int64)
                np.bitwise_or.at(part, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["c", "m"])

    def merged(t: pa.Table) -> pa.Table:
        m = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in t["m"].to_pylist()]))
        return pa.table({"c": t["c"].slice(0, 1), "m": pa.array([m.tobytes()], pa.binary())})

    got = found.select("h").mapInArrow(marks, "c int, m binary").groupBy("c").applyInArrow(merged, "c int, m binary").toArrow()
    bitmap = np.zeros((1 << bits) // 8, np.uint8).reshape(1024, -1)
    for c, m in zip(got["c"].to_pylist(), got["m"].to_pylist(), strict=True):
        bitmap[c] = np.frombuffer(m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))
    sizes = sorted({y - x for x, y in pieces(span, errors)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t)
                if len(ws) < span - errors:
                    continue
                for size in sizes:
                    h = np.array([_hash(ws[k : k + size]) for k in range(len(ws) - size + 1)], np.int64)
                    at = (h.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                    for k in np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        lo = max(0, k - span - errors)
                        out.append((int(h[k]), d, k, lo, " ".join(ws[lo : k + span + errors])))
            for i in range(0, max(1, len(out)), 20_000):
                part = out[i : i + 20_000]
                cols = zip(*part, strict=True) if part else [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["h", "doc_id", "k", "lo", "around"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, k, lo, around, i, s, x, span_words in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                ws = around.split(" ")
                start = max(0, k - x - errors)
                dist, to = myers(span_words.split(" "), ws[start - lo : k - lo - x + span + errors], errors)
                if dist <= errors:
                    out.append((d, i, s, dist, max(0, start + to - span + 1)))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "eval_id", "span", "distance", "first_word"])

    near = docs.mapInArrow(scan, "h bigint, doc_id bigint, k int, lo int, around string")
    return near.join(found, "h").select("doc_id", "k", "lo", "around", "i", "s", "a", "words").mapInArrow(check, _HITS)


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "eval_id",
    passage: str = "passage",
    span: int = 13,
    errors: int = 1,
    automaton_items: int = 20_000,
) -> DataFrame:
    """(doc_id, eval_id, distance, spans, item_spans, first_word): documents that hold an item wholly or partly.

    A span is `span` consecutive words of an item. A document holds it where some stretch of its words is within
    `errors` word edits. Each span is cut into errors + 1 pieces, one of which such a stretch holds unchanged;
    exact piece hits come from an automaton, and Myers' distance decides. distance: the least over the item's spans;
    spans: how many are held, of item_spans; first_word: where the nearest one begins in the document.
    Items shorter than `span` words match nothing. Null ids, null and empty texts match nothing; an id sent more than
    once counts once, with its best match over its rows. Other columns are not read. No text is cut.

    The corpus is scanned once, and matches alone are shuffled. Up to automaton_items items go into an automaton that is broadcast (as their words); more of them
    are looked up by hashes of their pieces (64 bits, exact pieces then decided by the same distance), which are joined: _joined_hits.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).dropna().distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    schema = "doc_id bigint, eval_id bigint, distance int, spans int, item_spans int, first_word int"
    part = [(r["i"], r["p"]) for r in rows.limit(automaton_items + 1).collect()]
    if len(part) <= automaton_items:
        shared = spark.sparkContext.broadcast([(i, words(p)) for i, p in part])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _Matcher(shared.value, span, errors)
            for b in batches:
                out = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k, held in m.spans(t).items():
                        best, first = min(held.values())
                        out.append((d, m.items[k][0], best, len(held), max(0, len(m.items[k][1]) - span + 1), first))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)

        found = texts.mapInArrow(run, schema)
    else:
        cut = keep(_span_pieces(rows, span, errors), "pieces")
        size = cut.groupBy("i").agg((F.max("s") + 1).cast("int").alias("item_spans"))
        hits = _joined_hits(texts, cut, span, errors).groupBy("doc_id", "eval_id", "span").agg(F.min(F.struct("distance", "first_word")).alias("m"))
        found = hits.groupBy("doc_id", "eval_id").agg(F.min("m").alias("m"), F.count("*").cast("int").alias("spans")).join(size.withColumnRenamed("i", "eval_id"), "eval_id")
        found = found.select("doc_id", "eval_id", "m.distance", "spans", "item_spans", "m.first_word")
    best = found.groupBy("doc_id", "eval_id").agg(F.min(F.struct("distance", F.negative("spans").alias("s"), "item_spans", "first_word")).alias("m"))
    return best.select("doc_id", "eval_id", "m.distance", F.negative("m.s").alias("spans"), "m.item_spans", "m.first_word")
