"""Near-duplicate records: a blocked sparse product of the document by word incidence with its transpose.

Rows are sorted rarest word first. A pair of rows with Jaccard similarity of t or more shares so many words that it
shares one in the rare ends of both rows, two in ends one word longer, three in ends two longer; so the product is
taken over the ends alone, block by block of words. Within a block, a word held by few rows is multiplied out at
once; one held by many is first narrowed to rows that share a second, third ... word (counts accumulate before any pair
is made), as words that come together, such as those of a title, tell no more than one. Pairs that the sizes or the words missing from 256-bit row sketches rule out are
discarded; for those left the overlap is accumulated over the whole rows, all pairs of a batch in one sorted product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import words
from wakeline.storage import brief_shuffles, keep

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: so many words are shared at most before pairs are made, and from groups of which size on another one is asked for
LEVELS = 5
DIRECT = (0, 300, 2000, 2000, 4000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words:
    """32-bit hashes of words, kept per task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def row(self, texts: tuple) -> list[int]:
        ws = {w for t in texts for w in words(t)}
        if len(self.known) > 500_000:
            self.known.clear()
        out = []
        for w in ws:
            h = self.known.get(w)
            if h is None:
                h = self.known[w] = xxhash.xxh32_intdigest(w)
            out.append(h)
        return out


def _rows(batch: pa.RecordBatch, hashes: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(words per row, all rows' hashes) of a batch's text columns (all but the first)."""
    cols = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
    rows = [hashes.row(t) for t in zip(*cols, strict=True)]
    return np.array([len(r) for r in rows], np.int64), np.array([h for r in rows for h in r], np.uint32)


def _binary(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, values per row) of a binary column, copied from its buffers."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.frombuffer(raw.tobytes(), kind), np.diff(at).astype(np.int64) // width


def rarity(rows: DataFrame, size: int = 1 << 18) -> np.ndarray:
    """In how many rows (toks binary) each word hash (modulo size) occurs: what words are ordered by. Bounded by size; any order is correct."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(_binary(b.column(0), np.uint32)[0] % size, minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    got = rows.select("toks").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


class _Block:
    """The rows' ends that hold words of one block, and the pairs their product leaves."""

    def __init__(self, t: float, rep, n, first, size, tok, sig, most_at_once=600_000):
        self.t, self.rep, self.n, self.sig, self.most = t, rep, n, sig, most_at_once
        self.first, self.tok = first, tok
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.probe = n - _up(t * n)  # words that may be missing towards a smaller row, and towards a larger one
        self.index = n - _up(2 * t / (1 + t) * n)
        self.found: list[np.ndarray] = []
        self.heavy: list[tuple] = []
        self.need = _up(t / (1 + t) * np.arange(4096)).astype(np.int32)  # by the sum of two rows' sizes

    def entries(self, wanted) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word key, row, position in its whole sorted row) of the words in the ends of level 1 for which wanted(word, key) holds, some rows at a time."""
        out = []
        for i in range(0, len(self.n), 20_000):
            j = min(i + 20_000, len(self.n))
            size = np.diff(self.start[i : j + 1])
            row = np.repeat(np.arange(i, j), size)
            pos = np.arange(self.start[i], self.start[j]) - self.start[row] + self.first[row]
            w = self.tok[self.start[i] : self.start[j]]
            key = _mix(w)
            ok = (pos < self.probe[row] + 1) & wanted(w, key)
            out.append((key[ok], row[ok], pos[ok]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def word(self, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return self.tok[self.start[row] + pos - self.first[row]]

    def extend(self, key, row, pos, level, own=None):
        """Entries of level + 1: each entry with every later word of its row's end."""
        last = np.minimum(self.probe[row] + level + 1, self.first[row] + np.diff(self.start)[row])
        more = np.maximum(last - pos - 1, 0)
        at = np.repeat(np.arange(len(row)), more)
        nxt = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + pos[at] + 1
        r = row[at]
        k = _mix(key[at] ^ _mix(self.word(r, nxt)))
        if own is not None:
            ok = own(k)
            return k[ok], r[ok], nxt[ok]
        return k, r, nxt

    def limits(self, row, pos, level: int) -> np.ndarray:
        """The largest size a smaller partner of each entry may have: the words up to its place, counted ones aside, are not shared."""
        n = self.n[row]
        rest = n - pos - 1 + level
        return np.minimum(np.floor(rest * (1 + self.t) / self.t + 1e-9).astype(np.int64) - n, n)

    def work(self, key, row, pos, level: int, direct=DIRECT) -> None:
        """Groups of entries with equal keys: pairs of small groups, longer keys for large ones. Keys are taken to 48 bits; keys that
        then coincide only add pairs to discard."""
        key = key >> np.uint64(16) << np.uint64(16)
        order = np.argsort(key)
        key, row, pos = key[order], row[order], pos[order]
        size = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]))
        large = np.repeat(size > direct[level], size) if level < LEVELS else np.zeros(len(key), bool)
        self.pairs(key, row, pos, level, ~large)
        if large.any():
            # pairs that need no more words than the level has: small rows
            self.pairs(key, row, pos, level, large & (self.n[row] <= level / self.t + 1e-9))
            group = np.repeat(np.arange(len(size), dtype=np.int32), size)
            at = np.flatnonzero(large)
            width = np.cumsum((self.probe[row[at]] + level + 1 - pos[at]).clip(0))
            cut_at, g = 0, group[at]
            while cut_at < len(at):
                base = width[cut_at - 1] if cut_at else 0
                end = int(np.searchsorted(width, base + self.most, "right"))
                end = max(end, cut_at + 1)
                end = int(np.searchsorted(g, g[min(end, len(at)) - 1], "right"))  # whole groups
                part = at[cut_at:end]
                cut_at = end
                turns = -(-int(width[end - 1] - base) // (4 * self.most))
                for turn in range(turns):  # a group too large to extend at once: its longer keys in turns
                    some = (lambda k, turn=turn: (k >> np.uint64(20)) % np.uint64(turns) == turn) if turns > 1 else None
                    steps = [part[i : i + 50_000] for i in range(0, len(part), 50_000)] if turns > 1 else [part]
                    longer = [self.extend(key[x], row[x], pos[x], level, some) for x in steps]
                    self.work(*(np.concatenate(x) for x in zip(*longer, strict=True)), level + 1, direct)

    def pairs(self, key, row, pos, level: int, use) -> None:
        """Every entry of a short end with the entries of larger rows that can take a partner of its size; then discards by the
        words the smaller row can still share, and by the sketches."""
        at = np.flatnonzero(use)
        if len(at) < 2:
            return
        key, r, p = key[at], row[at].astype(np.int32), pos[at]
        limit = self.limits(r, p, level)
        can = np.flatnonzero(limit >= _up(self.t * self.n[r]))
        code = key[can] | np.clip(limit[can], 0, 0xFFFF).astype(np.uint64)
        order = np.argsort(code)
        code, right = code[order], r[can[order]]
        left = np.flatnonzero(p < self.index[r] + level)
        size = self.n[r[left]]
        start = np.searchsorted(code, key[left] | np.minimum(size, 0xFFFF).astype(np.uint64), "left")
        more = np.searchsorted(code, key[left] | np.uint64(0xFFFF), "right") - start
        # the largest size of a larger partner: by the words left of this one, and by the sizes alone
        most = np.minimum(np.floor((size - p[left] - 1 + level) * (1 + self.t) / self.t + 1e-9) - size, np.floor(size / self.t + 1e-9)).astype(np.int32)
        left = r[left]
        # by the places of both sides' entries, so that a group's sketches lie together
        n_l, n_r = self.n[left].astype(np.int32), self.n[right].astype(np.int32)
        sig_l, sig_r = np.ascontiguousarray(self.sig[left].T), np.ascontiguousarray(self.sig[right].T)
        total = np.cumsum(more)
        i0 = 0
        while i0 < len(left):
            base = total[i0 - 1] if i0 else 0
            i1 = max(int(np.searchsorted(total, base + self.most // 2, "right")), i0 + 1)
            m = more[i0:i1]
            b = np.arange(int(m.sum())) + np.repeat(start[i0:i1] - (np.cumsum(m) - m), m)
            size_b = n_r.take(b)
            ok = np.flatnonzero(size_b <= np.repeat(most[i0:i1], m))
            a, b, size_b = np.repeat(np.arange(i0, i1), m).take(ok), b.take(ok), size_b.take(ok)
            i0 = i1
            size_a = n_l.take(a)
            need = self.need.take(size_a + size_b) if len(self.need) > 2 * int(self.n.max()) else _up(self.t / (1 + self.t) * (size_a + size_b))
            room = (size_a - need).astype(np.int32)  # words of the smaller row that may be missing from the larger one
            miss = np.bitwise_count(sig_l[0].take(a) & ~sig_r[0].take(b)).astype(np.int32)
            for w in range(1, 4):  # a word of the sketches at a time, over what is left
                miss += np.bitwise_count(sig_l[w].take(a) & ~sig_r[w].take(b))
                ok = np.flatnonzero(miss <= room)
                a, b, need, room, miss = a.take(ok), b.take(ok), need.take(ok), room.take(ok), miss.take(ok)
            miss = sum(np.bitwise_count(sig_r[w][b] & ~sig_l[w][a]).astype(np.int32) for w in range(4))
            ok = n_r[b] - miss >= need
            a, b = left[a[ok]], right[b[ok]]
            ok = a != b
            a, b = a[ok], b[ok]
            if len(a):
                self.found.append(np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b)))
                if len(self.found) > 64:
                    self.found = [np.unique(np.concatenate(self.found))]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        c = np.unique(np.concatenate(self.found)) if self.found else np.zeros(0, np.int64)
        x, y = self.rep[c >> 32], self.rep[c & 0xFFFFFFFF]
        return np.minimum(x, y), np.maximum(x, y)


def _blocks(rows: int, copies: float, rows_per_block: int, rows_per_task: int) -> int:
    """Number of blocks: a row's end is sent to as many blocks as it has keys (`copies`), or to all, and no task is to get over rows_per_task."""
    few = max(8, -(-rows // rows_per_block))
    return few if rows <= rows_per_task else max(few, math.ceil(rows * copies / rows_per_task))


def _rounds(blocks: int, copies: float, at_once: float) -> int:
    """Rounds in which the blocks are taken, so that a row's end is on disk about at_once times at most: of `copies` keys in so many blocks, some share one."""
    return max(1, math.ceil(blocks * (1 - (1 - 1 / blocks) ** copies) / at_once))


def _shared_words(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(overlap, words left, words right) of each pair of word sets: one product over the batch, whose entries are (pair, word), sorted; a word of both
    sides stands twice in a row."""
    n_l, n_r = (np.array([len(x) // 4 for x in side], np.int64) for side in (left, right))
    pair = np.concatenate([np.repeat(np.arange(len(left), dtype=np.uint64), n_l), np.repeat(np.arange(len(left), dtype=np.uint64), n_r)])
    code = np.sort(pair << np.uint64(32) | np.frombuffer(b"".join([*left, *right]), np.uint32))
    both = code[1:][code[1:] == code[:-1]] >> np.uint64(32)
    return np.bincount(both.astype(np.int64), minlength=len(left)), n_l, n_r


def similar_classes(df: DataFrame, key: str, texts: list[str], threshold: float = 0.6, rows_per_block: int = 24_000, rows_per_task: int = 480_000, rows_per_word: int = 50_000, copies_at_once: float = 8) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes (key, rep, n): every record's class of equal word sets, named by its smallest key, and the
    set's size. links (rep_a, rep_b, shared, similarity): pairs of classes, rep_a < rep_b, whose Jaccard similarity over
    the words of the text columns is at least threshold (over 0.5). Every such pair comes out, at any size of the data.

    Null texts are empty; records without any word are in no class; null keys are left out; a key sent again counts once
    per different text. No task gets over about rows_per_task rows' ends, and a word of over rows_per_word rows is spread over
    blocks by the words that follow it in the rows' ends, at any size of the data. Blocks are taken in rounds, whose shuffle files are
    removed one after the other, so that about copies_at_once copies of a row's end are on disk at a time. Repeated rows and groups of equal texts are one row of the product, however many. Words are told
    apart by 32-bit hashes: that two of a pair's words coincide, which shifts its count by one, has a chance of about 1e-6.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold: over 0.5, up to 1")
    t = threshold
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)]).filter("key is not null")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for b in batches:
            n, h = _rows(b, hashes)
            order = np.argsort(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | h)
            raw, at = h[order].tobytes(), np.concatenate([[0], np.cumsum(n)]) * 4
            toks = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
            ok = np.flatnonzero(n)
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(ok)),
                    pa.array([xxhash.xxh3_128_digest("\x1f".join(x or "" for x in row)) for row in zip(*(c.take(pa.array(ok)).to_pylist() for c in b.columns[1:]), strict=True)], pa.binary()),
                    pa.array([xxhash.xxh3_128_digest(toks[i]) for i in ok], pa.binary()),
                    pa.array(n[ok].astype(np.int32)),
                    pa.array([toks[i] for i in ok], pa.binary()),
                ],
                names=["key", "text", "h", "n", "toks"],
            )

    coded = src.mapInArrow(encode, "key bigint, text binary, h binary, n int, toks binary")
    coded = keep(coded, "word-rows")
    with brief_shuffles(spark):
        reps = keep(coded.groupBy("h").agg(F.min("key").alias("rep"), F.min("n").alias("n"), F.min("toks").alias("toks")), "word-classes")
    classes = coded.select("key", "text", "h").distinct().join(reps.select("h", "rep", "n"), "h").select("key", "rep", "n", "text")

    counts = rarity(reps)
    shared = spark.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts)
    stock = reps.agg(F.count("*").alias("n"), F.avg("n").alias("words")).first()
    copies = (1 - t) * (stock["words"] or 0) + 1
    blocks = _blocks(stock["n"], copies, rows_per_block, rows_per_task)
    rounds = _rounds(blocks, copies, copies_at_once)
    heavy = rows_per_word

    def own(k: np.ndarray) -> np.ndarray:
        return ((k >> np.uint64(17)) % np.uint64(blocks)).astype(np.int64)

    def ends(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        place = np.empty(len(rank), np.uint64)
        place[np.argsort(rank, kind="stable")] = np.arange(len(rank), dtype=np.uint64)
        for b in (whole.slice(i, 8192) for whole in batches for i in range(0, whole.num_rows, 8192)):
            rep, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            tok, size = _binary(b.column(2), np.uint32)
            start = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(len(n)), size)
            # rarest first: one sort of (row, place of the word's bucket by rarity, word); batches have under 2^14 rows, tables 2^18 places
            tok = np.sort(row.astype(np.uint64) << np.uint64(50) | place[tok % len(place)] << np.uint64(32) | tok).astype(np.uint32)
            every = tok.tobytes()
            pos = np.arange(len(tok)) - start[row]
            bits = np.zeros((len(n), 256), bool)
            bits[row, _mix(tok) >> np.uint64(56)] = True
            sig = np.packbits(bits, axis=1)
            probe = n - _up(t * n)
            first = pos < probe[row] + 1
            big = first & (rank[tok % len(rank)] > heavy)
            light = np.flatnonzero(first & ~big)
            key = _mix(tok[light])
            got = [np.stack([row[light], own(key), pos[light]])]
            at = np.flatnonzero(big)
            if len(at):
                more = np.maximum(np.minimum(probe[row[at]] + 2, size[row[at]]) - pos[at] - 1, 0)
                i = np.repeat(at, more)
                j = np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more) + i + 1
                got.append(np.stack([row[i], own(_mix(_mix(tok[i]) ^ _mix(tok[j]))), pos[i]]))
            e = np.concatenate(got, axis=1)
            e = e[:, e[1] % rounds == turn]
            code = e[0] * blocks + e[1]
            order = np.lexsort((e[2], code))
            lead = order[np.concatenate([[True], np.diff(code[order]) != 0])] if len(order) else order
            r, blk, p = e[0][lead], e[1][lead], e[2][lead]
            stop = np.minimum(probe[r] + LEVELS, size[r])
            toks = [every[x:y] for x, y in zip((4 * (start[r] + p)).tolist(), (4 * (start[r] + stop)).tolist(), strict=True)]
            sigs = [s.tobytes() for s in sig]
            for i in range(0, len(r), 20_000):
                s = slice(i, i + 20_000)
                yield pa.record_batch(
                    [pa.array(blk[s].astype(np.int32)), pa.array(rep[r[s]]), pa.array(n[r[s]].astype(np.int32)), pa.array(p[s].astype(np.int32)), pa.array(toks[s], pa.binary()), pa.array([sigs[x] for x in r[s]], pa.binary())],
                    names=["block", "rep", "n", "first", "toks", "sig"],
                )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        me = -1
        for b in batches:
            if b.num_rows:
                me = int(b.column(0)[0].as_py())
                (ta, size), (sa, _) = _binary(b.column(4), np.uint32), _binary(b.column(5), np.uint64)
                parts.append([b.column(1).to_numpy().copy(), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64), size, ta, sa])
        if not parts:
            return
        rank = shared.value
        rep, n, first, size, tok, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        blk = _Block(t, rep, n, first, size, tok, sig.reshape(-1, 4))
        blk.work(*blk.entries(lambda w, k: (rank[w % len(rank)] <= heavy) & (own(k) == me)), 1)
        big = blk.entries(lambda w, k: rank[w % len(rank)] > heavy)
        for i in range(0, len(big[0]), 100_000):  # each block makes its own share of the heavy words' pairs
            part = [x[i : i + 100_000] for x in big]
            big_keys = blk.extend(*part, 1, lambda k: own(k) == me)
            blk.heavy.append(big_keys)
        if blk.heavy:
            blk.work(*(np.concatenate(x) for x in zip(*blk.heavy, strict=True)), 2)
        a, b = blk.result()
        for i in range(0, len(a), 100_000):
            yield pa.record_batch([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["rep_a", "rep_b"])

    def near_pairs(turn: int) -> DataFrame:
        schema = "block int, rep bigint, n int, first int, toks binary, sig binary"
        sent = reps.select("rep", "n", "toks").mapInArrow(lambda batches: ends(batches, turn), schema)
        at = F.floor(F.col("block") / rounds).cast("int")
        return keep(sent.repartitionById(-(-blocks // rounds), at).mapInArrow(multiply, "rep_a bigint, rep_b bigint").distinct(), "near-pairs")

    with brief_shuffles(spark):
        near = near_pairs(0)
        for turn in range(1, rounds):
            near = near.union(near_pairs(turn))
        if rounds > 1:
            near = keep(near.distinct(), "near-pairs")

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, ta, tb = (b.column(i).to_pylist() for i in range(4))
            k, n_a, n_b = _shared_words(ta, tb)
            union = n_a + n_b - k
            ok = np.flatnonzero(k >= t * union - 1e-9)
            k, union, a, c = k[ok], union[ok], np.array(a, np.int64)[ok], np.array(c, np.int64)[ok]
            yield pa.record_batch([pa.array(a), pa.array(c), pa.array(k.astype(np.int32)), pa.array(k / np.maximum(union, 1))], names=["rep_a", "rep_b", "shared", "similarity"])

    ids = near.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    used = reps.select("rep", "toks").join(ids, "rep", "left_semi")
    both = near.join(used.select(F.col("rep").alias("rep_a"), F.col("toks").alias("ta")), "rep_a").join(used.select(F.col("rep").alias("rep_b"), F.col("toks").alias("tb")), "rep_b")
    links = both.select("rep_a", "rep_b", "ta", "tb").mapInArrow(count_shared, "rep_a bigint, rep_b bigint, shared int, similarity double")
    return classes, links


def similar_pairs(classes: DataFrame, links: DataFrame, expand: int = 64) -> DataFrame:
    """(a, b) with a < b: all pairs of records, of a class of equal word sets too. Only more than `expand` copies of one text are
    not multiplied out: they pair with their smallest key alone, which stands for them in the pairs with other texts."""
    copies = classes.groupBy("text").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    member = classes.select("key", "rep", "text").join(copies, "text").withColumn("small", F.col("copies") <= expand)
    star = member.filter("not small and key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    stands = member.filter("small or key = first").select("rep", F.col("key").alias("x"))
    also = stands.withColumnRenamed("x", "y")
    inner = stands.join(also, "rep").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    x = links.select("rep_a", "rep_b").join(stands.withColumnRenamed("rep", "rep_a"), "rep_a").join(also.withColumnRenamed("rep", "rep_b"), "rep_b")
    return star.union(inner).union(x.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): connected components of the edges, each named by its smallest node. Rounds of taking the least
    neighbouring label and following labels' labels; each round is a written table, and its number grows with the logarithm of the diameter."""
    both = keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    label = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("cv"))
        step = label.join(near, "u").select("u", F.least("c", "cv").alias("d"), F.col("c").alias("old"))
        # whoever gave its label takes over the better one its members found, then labels are followed once
        won = step.groupBy(F.col("old").alias("u")).agg(F.min("d").alias("w"))
        step = step.join(won, "u", "left").select("u", "old", F.least("d", F.coalesce("w", "d")).alias("d"))
        jump = step.select(F.col("u").alias("d"), F.col("d").alias("e"))
        step = keep(step.join(jump, "d", "left").select("u", "old", F.least("d", F.coalesce("e", "d")).alias("c")), "labels")
        changed = step.filter("c <> old").limit(1).count()
        label = step.select("u", "c")
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def duplicate_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, rep, links, group_key): one row per record with its class, the class's number of links to other classes, and the
    connected group of classes it belongs to (by smallest key); a record similar to none is its own group."""
    comp = components(links, "rep_a", "rep_b")
    n = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    return out.select("key", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("group_key"))
