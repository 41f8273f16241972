"""Text decoded with the wrong character encoding: a noisy-channel decoder over byte lattices.

A channel is a pair (written, read): bytes of a text written in one encoding were read in another. A token with
characters outside ASCII is turned back into the bytes each channel allows, a lost byte being a wildcard; a Viterbi
search finds the best reading of that lattice under character-pair counts of the corpus, corpus word frequencies rank
what it finds, and a reading replaces the token where it beats the token itself by more than the channel's cost. A token is decoded once
for the whole corpus, and a text put together once for all its copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.storage import keep

#: encodings that texts in Western and Cyrillic scripts are read in by mistake: fixed values
READ = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-5", "iso8859-15", "cp1250")
#: single-byte encodings that such texts are written in: fixed values
WRITTEN = ("cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "iso8859-5")
#: ln of how seldom characters that weren't misread make up a whole UTF-8 sequence
CHANCE = 2.5
LOST = "�"
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~"


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s)


def core(token: str) -> str:
    """What tokens are counted by: lower case, no ASCII punctuation at the ends, digits alike."""
    return re.sub(r"\d", "0", token.strip(_EDGE).lower())


class Model:
    """Corpus counts in tables of fixed size: words, character pairs, characters (of tokens with a character outside ASCII)."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, chars: dict[str, int]):
        self.words, self.pairs, self.chars = words, pairs, chars
        self.total = max(1, sum(chars.values()))

    def seen(self, token: str) -> int:
        return int(self.words[_hash(core(token)) % len(self.words)])

    @lru_cache(200_000)  # noqa: B019
    def step(self, a: str, b: str) -> float:
        """log of the probability that b follows a: pairs, backed off to characters."""
        one = (self.chars.get(b, 0) + 0.01) / (self.total + 100)
        return math.log((self.pairs[_hash(a + b) % len(self.pairs)] + 20 * one) / (self.chars.get(a, 0) + 20))

    def text(self, token: str) -> float:
        t = f" {token.lower()} "
        return sum(map(self.step, t, t[1:]))


@lru_cache(None)
def _to_bytes(codec: str) -> dict[str, int]:
    """Character to byte. Bytes a code page leaves open were read as control characters."""
    out = {chr(b): b for b in range(128, 160)} if codec != "latin-1" else {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(None)
def _to_char(codec: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            pass
    return out


def lattice(token: str, read: str) -> list[int | None] | None:
    """The token's bytes as `read` would have read them, None for a lost one; None if it can't have been."""
    table, out = _to_bytes(read), []
    for ch in token:
        if ch == LOST:
            out.append(None)
        elif ch in table:
            out.append(table[ch])
        else:
            return None
    return out


def viterbi(bytes_: list[int | None], written: str, model: Model, alphabet: list[tuple[str, bytes]], beam: int | None = 24) -> list[tuple[float, str]]:
    """Best readings of the lattice as text in `written`, by character pairs: [(score, text)].

    beam: how many states a column goes on with; None for all, which makes the search exact. Only for UTF-8 may a sequence's last bytes be missing before an ASCII byte or the end (blanks and control characters
    that were dropped): they are wildcards too.
    """
    n = len(bytes_)
    columns: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
    columns[0][" "] = (0.0, "")

    def put(at: int, ch: str, score: float, text: str) -> None:
        key = ch.lower()
        if at <= n and (key not in columns[at] or columns[at][key][0] < score):
            columns[at][key] = (score, text + ch)

    for i in range(n):
        col = columns[i]
        if beam is not None and len(col) > beam:
            col = dict(sorted(col.items(), key=lambda x: -x[1][0])[:beam])
        if not col:
            continue
        b = bytes_[i]
        options: list[tuple[int, str, float]] = []
        if b is not None and b < 128:
            options = [(i + 1, chr(b), 0.0)]
        elif written != "utf-8":
            table = _to_char(written)
            options = [(i + 1, table[b], 0.0)] if b in table else [] if b is not None else [(i + 1, ch, -0.5) for ch, raw in alphabet if len(raw) == 1]
        else:
            if b is not None:
                size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                chunk = bytes_[i : i + size]
                if size and len(chunk) == size and None not in chunk:
                    try:
                        options = [(i + size, bytes(chunk).decode(), CHANCE)]
                    except UnicodeDecodeError:
                        pass
            if not options and (b is None or b >= 0xC2):
                for ch, raw in alphabet:
                    k = 0
                    while k < len(raw) and i + k < n and (bytes_[i + k] is None or bytes_[i + k] == raw[k]):
                        k += 1
                    lost = len(raw) - sum(x is not None for x in bytes_[i : i + k])
                    if k == len(raw) or k and b is not None and (i + k == n or (bytes_[i + k] or 128) < 128):
                        options.append((i + k, ch, -2.0 * lost))
        for prev, (score, text) in col.items():
            for at, ch, cost in options:
                if cost < 0 and text and text[-1].islower() and ch.isupper():  # a guessed capital inside a word
                    cost -= 4.0
                put(at, ch, score + cost + model.step(prev, ch.lower()), text)
    return sorted(((s + model.step(p, " "), t) for p, (s, t) in columns[n].items()), reverse=True)


#: what whole UTF-8 sequences in misread words stand for: letters of two bytes, punctuation and signs, emoji
_MISREAD = re.compile("[\x00-\u05ff\u2000-\u214f\U0001f000-\U0001faff]+")


@lru_cache(200_000)
def whole_utf8(token: str) -> frozenset[str]:
    """The channels by which the token's bytes make up whole UTF-8 sequences, as they seldom do unless it was misread."""
    out = set()
    for read in READ:
        raw = lattice(token, read)
        if raw is not None and None not in raw:
            try:
                if _MISREAD.fullmatch(bytes(raw).decode()):
                    out.add(f"utf-8>{read}")
            except UnicodeDecodeError:
                pass
    return frozenset(out)


class Decoder:
    """Decodes tokens. beam: states of a Viterbi column that go on; readings: how many of a lattice's best readings in UTF-8, and in a single-byte
    encoding, are ranked by word frequencies; least_seen: how often a character must occur to stand for lost bytes. beam None, readings (None, None) and
    least_seen 1 leave nothing out."""

    def __init__(self, model: Model, margin: float = 4.0, beam: int | None = 24, readings: tuple[int | None, int | None] = (6, 3), least_seen: int = 2):
        self.model, self.margin, self.beam, self.most = model, margin, beam, readings
        wide = [c for c in model.chars if ord(c) > 127 and c != LOST and model.chars[c] >= least_seen]
        every = sorted(set(wide) | {c.upper() for c in wide if len(c.upper()) == 1})
        self.utf8 = [(c, c.encode("utf-8", "surrogatepass")) for c in every]
        self.single = {w: [(c, b"?") for c in every if c in _to_char(w).values()] for w in WRITTEN}

    def readings(self, token: str) -> Iterator[tuple[float, str, str]]:
        """(score, text, channel) of each channel that could have made the token."""
        seen_bytes = set()
        for read in READ:
            raw = lattice(token, read)
            if raw is None or tuple(raw) in seen_bytes:
                continue
            seen_bytes.add(tuple(raw))
            for score, text in viterbi(raw, "utf-8", self.model, self.utf8, self.beam)[: self.most[0]]:
                yield score + 1.0, text, f"utf-8>{read}"
                twice = lattice(text, "cp1252")
                if twice is not None and any(ord(c) > 127 for c in text):
                    for s2, t2 in viterbi(twice, "utf-8", self.model, [], self.beam):
                        yield s2 + 1.0, t2, f"utf-8>{read} twice"
            for written in WRITTEN:
                if written != read and None not in raw:
                    for score, text in viterbi(raw, written, self.model, self.single[written], self.beam)[: self.most[1]]:
                        yield score - 5.0, text, f"{written}>{read}"
        if LOST in token:
            for written in WRITTEN[:2]:
                raw = [None if c == LOST else ord(c) if ord(c) < 128 else -1 for c in token]
                if -1 not in raw:
                    for score, text in viterbi(raw, written, self.model, self.single[written], self.beam):
                        yield score - 3.0, text, f"{written}>utf-8"

    def token(self, token: str) -> tuple[str, str, float, dict[str, str]]:
        """(text, channel, by how much it beats the token, readings that nearly do by channel); an untouched token has channel ''."""
        m = self.model
        own = m.text(token) + 1.5 * math.log1p(m.seen(token))
        best, near = ("", token, 0.0), {}
        for score, text, channel in self.readings(token):
            gain = score + 1.5 * math.log1p(m.seen(text)) - own
            if LOST in token:  # a lost byte is no character of any text
                gain += 40.0
            if text != token and gain > max(self.margin, best[2]):
                best = (channel, text, gain)
            if text != token and gain > -12 and channel.startswith("utf-8>"):
                near.setdefault(channel, text)
        return best[1], best[0], best[2], near


def put_together(text: str, decoded: dict[str, tuple[str, str, float, dict[str, str]]]) -> tuple[str, str, int]:
    """(restored text, the channel most of its tokens came through, number of garbled tokens), from what its tokens were decoded to."""
    found = [decoded.get(t, (t, "", 0.0, {})) for t in _TOKEN.findall(text)]
    gains: dict[str, float] = {}
    for _, channel, gain, _ in found:
        gains[channel] = gains.get(channel, 0.0) + gain
    # one code page read as another leaves valid text; it takes more than one short word to tell
    weak = {c for c, g in gains.items() if c and not c.startswith("utf-8>") and not c.endswith(">utf-8") and g < 12}
    votes: dict[str, int] = {}
    each = iter(found)
    lead = max(gains, key=lambda c: (gains[c] if c.startswith("utf-8>") else 0.0, c)) if gains else ""

    def swap(m: re.Match) -> str:
        better, channel, _, near = next(each)
        if not channel and gains.get(lead, 0) >= 8 and lead in near:  # rare words go the way of their text
            better, channel = near[lead], lead
        if channel in weak or not channel and LOST not in m[0]:
            return m[0]
        votes[channel or "lost"] = votes.get(channel or "lost", 0) + 1
        return better

    out = _TOKEN.sub(swap, text)
    return out, max(votes, key=lambda c: (votes[c], c)) if votes else "", sum(votes.values())


_COUNTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])


def train(tokens_: DataFrame, word_buckets: int = 1 << 20, pair_buckets: int = 1 << 18) -> Model:
    """The model of the corpus's tokens (token, n). Tokens that read as whole UTF-8 sequences don't count, so that damage that was repeated doesn't vouch for
    itself. What reaches the driver is bounded by the table sizes and by Unicode's characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = np.zeros(word_buckets, np.int64), np.zeros(pair_buckets, np.int64)
        chars = np.zeros(0x110000, np.int64)
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if whole_utf8(t):
                    continue
                words[_hash(core(t)) % word_buckets] += n
                p = f" {t.lower()} "
                for x, y in zip(p, p[1:], strict=False):
                    pairs[_hash(x + y) % pair_buckets] += n
                    chars[ord(x)] += n
        for kind, a in enumerate((words, pairs, chars)):
            at = np.flatnonzero(a)
            for i in range(0, len(at), 100_000):
                x = at[i : i + 100_000]
                yield pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(a[x])], schema=_COUNTS)

    got = tokens_.select("token", "n").mapInArrow(count, "kind int, bucket bigint, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (got[c].to_numpy() for c in ("kind", "bucket", "n"))
    words, pairs = np.zeros(word_buckets, np.int64), np.zeros(pair_buckets, np.int64)
    words[bucket[kind == 0]], pairs[bucket[kind == 1]] = n[kind == 0], n[kind == 1]
    return Model(words, pairs, {chr(c): int(k) for c, k in zip(bucket[kind == 2], n[kind == 2], strict=True)})


def garbled(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    margin: float = 4.0,
    word_buckets: int = 1 << 20,
    beam: int | None = 24,
    readings: tuple[int | None, int | None] = (6, 3),
    least_seen: int = 2,
) -> DataFrame:
    """(doc_id, channel, garbled_tokens, restored) of every record whose text, or a part of it, was read in the wrong encoding.

    restored: the whole text with each garbled token replaced by its best reading; what can't be restored stays as it
    is. A replacement character always counts as damage. Null ids, null and empty texts are not affected; an id sent more
    than once counts once (its row with most garbled tokens, then the smallest restored text). An empty table gives no rows. Other
    columns are not read. beam, readings, least_seen: see Decoder.

    Texts with a character outside ASCII are taken once each, whatever the number of their copies, which weigh 1 + log2 of it. Their distinct
    tokens are counted; the model is trained on these counts; each distinct token is decoded once; texts that hold a garbled one are put together and
    joined to their ids.
    """
    spark = df.sparkSession
    wide = F.col("t").rlike(r"[^\x00-\x7F]")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).filter(wide).withColumn("h", F.md5("t"))
    parts = F.filter(F.split("t", r"[ \t\r\n]+"), lambda x: x.rlike(r"[^\x00-\x7F]"))
    texts = rows.groupBy("h").agg(F.first("t").alias("t"), F.round(1 + F.log2(F.count("*"))).cast("long").alias("k"))
    texts = keep(texts.withColumn("parts", parts), "wide-texts")
    counts = keep(texts.select(F.explode("parts").alias("token"), "k").groupBy("token").agg(F.sum("k").alias("n")), "wide-tokens")
    m = train(counts, word_buckets)
    shared = spark.sparkContext.broadcast((m.words.astype(np.int32) if m.words.max(initial=0) < 2**31 else m.words, m.pairs, m.chars))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(Model(*shared.value), margin, beam, readings, least_seen)
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                better, channel, gain, near = d.token(t)
                if channel or near or LOST in t:
                    out.append((t, better, channel, gain, list(near.items())))
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["token", "better", "channel", "gain", "near"])

    spread = spark.sparkContext.defaultParallelism
    many = counts.select("token").repartition(max(spread, 1)) if counts.rdd.getNumPartitions() < spread else counts.select("token")
    decoded = keep(many.mapInArrow(decode, "token string, better string, channel string, gain double, near map<string,string>"), "decoded")
    held = texts.select("h", F.explode(F.array_distinct("parts")).alias("token")).join(decoded, "token")
    bad = (F.col("channel") != "") | F.col("token").contains(LOST)
    held = held.groupBy("h").agg(F.collect_list(F.struct("token", "better", "channel", "gain", "near")).alias("found"), F.max(bad).alias("bad")).filter("bad")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                restored, channel, n = put_together(t, {x["token"]: (x["better"], x["channel"], x["gain"], dict(x["near"])) for x in found})
                if n:
                    out.append((h, channel, n, restored))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["h", "channel", "garbled_tokens", "restored"])

    found = keep(texts.join(held, "h").select("h", "t", "found").mapInArrow(assemble, "h string, channel string, garbled_tokens int, restored string"), "restored")
    each = rows.filter("doc_id is not null").select("doc_id", "h").join(found, "h")
    first = each.groupBy("doc_id").agg(F.min(F.struct(F.negative("garbled_tokens").alias("g"), "restored", "channel")).alias("m"))
    return first.select("doc_id", "m.channel", F.negative("m.g").alias("garbled_tokens"), "m.restored")
