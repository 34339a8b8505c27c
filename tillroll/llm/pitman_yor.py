"""Log-probabilities of texts under a hierarchical Pitman-Yor language model.

Every word that a token follows is a restaurant; its dishes are the tokens
that follow it, its customers their occurrences in the texts learnt from.  All
restaurants share one parent, whose customers are their tables, and the
parent's base is uniform over the vocabulary and one unknown word.  Seatings
(table sizes) are sampled by Gibbs: customers leave and sit down again, at a
table of their dish in proportion to size - discount, or at a new one in
proportion to (strength + discount * tables) * the parent's probability; a
move is one of all customers of a dish together (``Seats.move``).  A token's
probability is the mean over the samples of

    (c - d t + (strength + d T) * parent(w)) / (strength + C).

How the work is dealt.  A map task turns its documents into packs: each pack
holds its distinct words (64-bit hashes) and its token stream in their local
numbers.  A pack's distinct (context, word) pairs go, with their counts, to
shards by hash of the context; contexts that hold more than a shard's share of
all tokens are cut into sections by hash of the word.  A shard adds up counts
and seats the dishes that occur twice or more (a single customer has one
table), all dishes side by side.  Between rounds the shards send tables by word to the
parent's shards, which seat them and answer with the parent's probabilities.
A shard also keeps, for each pack, the places of what the pack asked for, so at
the end it answers with counts and tables without being asked again, and the
packs add up their documents.  No task holds more than a pack or a shard, and
only counts (vocabulary, tokens, counts of counts) and the split contexts, at
most one for each shard, reach the driver.

Contexts are single words: two words of context would mean a table two thirds
as long as the corpus itself (89 million distinct triples in 135 million
tokens of the half-gigabyte check table; 48 million pairs).

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then
one end token, which is also the context of a text's first token; null, empty
and wordless texts consist of the end alone.  Rows are scored one by one,
however often an id or a text repeats; a null id is neither held out nor
learnt from (``held_out`` null).  Without any text to learn from every token
has probability 1 (the vocabulary is empty, all words are the unknown one).
Long texts are tokenised in pieces; a text is never split between packs.
Tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import SEPARATORS, blocks, need, small_batches
from .words import mix, words_of

#: Tokens of a pack, and tokens that a shard aims to hold.
PACK, SHARD = 800_000, 800_000
#: Bytes of one text that are tokenised at once.
PIECE = 1 << 20
#: Rounds of seating before the sampled one; moves of all of a dish's customers in a sweep; sweeps of a burning round; samples.
BURN, MOVES, SWEEPS, SAMPLES = 1, 3, 2, 3
STRENGTH = 1.0
#: The end token's hash.
END = np.uint64(0x5851F42D4C957F2D)
_SEED = 13


# ---- packed whole numbers ----

def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes of the least width."""
    a = np.ascontiguousarray(a)
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    planes = a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{b[0]}").ravel().astype(kind)


def ascending(at: np.ndarray) -> bytes:
    """Packed places that never descend."""
    return pack(np.diff(at, prepend=0))


def samples_of(values: list[np.ndarray]) -> list[bytes]:
    """Numbers of each sample: the first, then small differences to it."""
    return [pack(values[0]), *[pack(((v - values[0]) << 1) ^ ((v - values[0]) >> 63)) for v in values[1:]]]


def each_sample(packed: list[bytes]) -> list[np.ndarray]:
    first = unpack(packed[0])
    return [first, *[first + ((v >> 1) ^ -(v & 1)) for v in map(unpack, packed[1:])]]


def short(h: np.ndarray) -> np.ndarray:
    """A word's 48-bit name inside a restaurant."""
    return h >> np.uint64(16)


def home(h: np.ndarray, shards: int) -> np.ndarray:
    return (short(h) % np.uint64(shards)).astype(np.int64)


# ---- texts to packs ----

def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text):  # on to the next separator, looked for in steps
            near = np.flatnonzero(SEPARATORS[np.frombuffer(text[end:end + 65536], np.uint8)])
            if len(near):
                end += int(near[0])
                break
            end += 65536
        yield text[at:end]
        at = end


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows' tokens, each row's ended by END, tokens of each row)."""
    out, count = [], np.zeros(len(texts), np.int64)
    for a, b in blocks(texts, PIECE):
        if b == a + 1 and texts[a].is_valid and len(raw := texts[a].as_buffer()) > PIECE:
            own = [words_of(pa.array([p], pa.large_binary()), lower=True).hash for p in _pieces(raw.to_pybytes())]
            out += [*own, np.array([END])]
            count[a] = sum(map(len, own)) + 1
            continue
        w = words_of(texts.slice(a, b - a), lower=True)
        n = np.diff(w.first)
        all_ = np.empty(len(w.hash) + b - a, np.uint64)
        ends = np.cumsum(n + 1) - 1
        inside = np.ones(len(all_), dtype=bool)
        inside[ends] = False
        all_[inside], all_[ends] = w.hash, END
        out.append(all_)
        count[a:b] = n + 1
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), count


PACKS = "pack bigint, ids binary, fold binary, counts binary, words binary, stream binary, top array<struct<h:bigint,n:bigint>>, tokens bigint"


def packs(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, held, text) -> packs of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, number = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            for a, b in blocks(texts, 8 * PIECE):
                tokens, count = tokens_of(texts.slice(a, b - a))
                held.append((batch.column("doc_id")[a:b], batch.column("held")[a:b], count, tokens))
                total += len(tokens)
                if total >= PACK:
                    yield close(held, number)
                    held, total, number = [], 0, number + 1
        if held:
            yield close(held, number)

    def close(held: list, number: int) -> pa.RecordBatch:
        ids, out = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        # 0: learnt from, 1: held out, 2: no id
        fold = np.where(out.is_null().to_numpy(zero_copy_only=False), 2, out.fill_null(False).to_numpy(zero_copy_only=False).astype(int))
        words, local, n = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        top = np.flatnonzero(n * 4 * shards >= len(local))
        tops = [{"h": int(h), "n": int(k)} for h, k in zip(words[top].view(np.int64), n[top], strict=True)]
        row = [number, ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), pack(fold), pack(np.concatenate([h[2] for h in held])),
               pack(words[often]), pack(rank[local]), tops, len(local)]
        kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in PACKS.split(", ")])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, PACKS)


@dataclass
class Split:
    """Contexts with more than a shard's share of all tokens, and their sections."""

    hashes: np.ndarray
    sections: np.ndarray

    def index(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the list, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)


class Pairs:
    """A pack's distinct pairs, ordered by (shard, context, word), and its words by hash."""

    def __init__(self, words: bytes, stream: bytes, counts: bytes, fold: bytes, split: Split, shards: int):
        w = unpack(words, np.uint64)
        by_hash = np.argsort(w)
        place = np.empty(len(w), np.int64)
        place[by_hash] = np.arange(len(w))
        self.words = w[by_hash]
        self.token = place[unpack(stream)]
        self.counts, self.fold = unpack(counts), unpack(fold)
        end = int(np.searchsorted(self.words, END))
        key = np.empty(len(self.token), np.int64)
        key[0], key[1:] = end, self.token[:-1]
        key *= len(self.words)
        key += self.token
        learnt = np.repeat(self.fold == 0, self.counts)
        ordered = np.sort(key * 2 + learnt)
        head = np.ones(len(ordered), dtype=bool)
        head[1:] = ordered[1:] >> 1 != ordered[:-1] >> 1
        first = np.flatnonzero(head)
        self.key, self.distinct = key, ordered[first] >> 1
        self.n = np.add.reduceat(ordered & 1, first) if len(first) else np.empty(0, np.int64)
        u, self.w = self.distinct // len(self.words), self.distinct % len(self.words)
        own = home(self.words, shards)
        self.home = own
        hot = split.index(self.words)
        # a context's number in a message: its place among the home shard's words, or, if split, after all of those
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(shards + 1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - starts[own[order]]
        self.edges, self.by_home = starts, order
        shard, code = own[u], rank[u]
        is_hot = hot[u] >= 0
        if is_hot.any():
            at = hot[u[is_hot]]
            section = (mix(short(self.words[self.w[is_hot]])) % split.sections[at].astype(np.uint64)).astype(np.int64)
            shard[is_hot] = (shard[is_hot] + section) % shards
            code[is_hot] = len(self.words) + at
        self.shard_of = shard
        self.order = np.lexsort((code, shard))
        self.shard, self.code = shard[self.order], code[self.order]
        self.n_split = len(split.hashes)

    def messages(self, number: int, shards: int) -> Iterator[dict]:
        edge = np.searchsorted(self.shard, np.arange(shards + 1))
        for s in range(shards):
            mine = self.order[edge[s]:edge[s + 1]]
            words = self.words[self.by_home[self.edges[s]:self.edges[s + 1]]]
            if not len(mine) and not len(words):
                continue
            code = self.code[edge[s]:edge[s + 1]].copy()
            code[code >= len(self.words)] -= len(self.words) - len(words)
            yield {"shard": s, "pack": number, "words": pack(words), "per": pack(np.bincount(code, minlength=len(words) + self.n_split)),
                   "w": pack(short(self.words[self.w[mine]])), "n": pack(self.n[mine])}


MESSAGES = "shard int, pack bigint, words binary, per binary, w binary, n binary"


def messages(table: DataFrame, split: Split, shards: int) -> DataFrame:
    kinds = pa.schema([("shard", pa.int32()), ("pack", pa.int64()), *[(c, pa.binary()) for c in ("words", "per", "w", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *packed in zip(*(batch.column(c).to_pylist() for c in ("pack", "words", "stream", "counts", "fold")), strict=True):
                p = Pairs(*packed, split, shards)
                yield pa.RecordBatch.from_pylist(list(p.messages(number, shards)), kinds)

    return table.select("pack", "words", "stream", "counts", "fold").mapInArrow(run, MESSAGES)


# ---- seating ----

def start(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(table sizes, their dish) to begin with, for c customers: they come in batches of a quarter of those who are there.

    ``a`` is the weight of a dish's new table while it has none, ``p`` the parent's probability.
    """
    n, t = np.ones(len(c), np.int64), np.ones(len(c), np.int64)
    size, own = np.ones(len(c), np.int64), np.arange(len(c))
    while (more := np.minimum(np.maximum(n // 4, 1), c - n)).any():
        weight = a + d * t * p
        new = rng.binomial(more, weight / (weight + n - d * t))
        joined = more - new
        grown = size + (size * joined[own]) // n[own]
        first = np.searchsorted(own, np.arange(len(c)))
        grown[first] += joined - (np.add.reduceat(grown, first) - n)
        n, t = n + more, t + new
        own = np.concatenate([own, np.repeat(np.arange(len(c)), new)])
        size = np.concatenate([grown, np.ones(new.sum(), np.int64)])
        order = np.argsort(own, kind="stable")
        size, own = size[order], own[order]
    return size, own


def _log_weight(n: np.ndarray, d: float) -> np.ndarray:
    """log(gamma(n - d) / (gamma(1 - d) gamma(n))) for whole n from 1 on."""
    def stirling(x):
        return (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x ** 3)
    few = np.concatenate(([0.0], np.cumsum(np.log1p(-d / np.arange(1, 256)))))
    out = few[np.minimum(n, 256) - 1]
    large = n > 256
    x = n[large].astype(float)
    out[large] += stirling(x - d) - stirling(x) - (stirling(256.0 - d) - stirling(256.0))
    return out


def _tilt(c: np.ndarray, rate: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(1 - x, groups) of each dish: with sizes weighted by x to the size, its tables hold c customers on average, and a group
    holds a few times what the table of a random customer does (one group where a single table holds most of the dish).
    Any values are right; these are seldom refused."""
    goal = np.log(c / (d * rate))
    z = np.where(goal < 0, goal, goal / (1 - d))  # x as log odds; x * (1 - x) ** (d - 1) is to be c / (d * rate)
    for _ in range(2):
        z -= ((1 - d) * np.logaddexp(0, z) - np.logaddexp(0, -z) - goal) / (1 - d * np.exp(-np.logaddexp(0, -z)))
    gap = np.minimum(np.exp(-np.logaddexp(0, z)), 1 - 1e-9)
    many = gap * (c + 1) > 1
    gap = np.where(many, gap, 1 / (c + 1))
    return gap, np.where(many, np.maximum(c / (4 + 4 * (1 - d) * (1 - gap) / gap), 1), 1).astype(np.int64)


class Seats:
    """Tables of many dishes: flat sizes, ordered by dish."""

    def __init__(self, size: np.ndarray, own: np.ndarray, dishes: int, restaurant: np.ndarray, others: np.ndarray):
        self.restaurant, self.others, self.dishes = restaurant, others, dishes
        self._set(size, own)

    def _set(self, size: np.ndarray, own: np.ndarray) -> None:
        order = np.argsort(own, kind="stable")
        self.size, self.own = size[order], own[order]
        self.t = np.bincount(own, minlength=self.dishes)

    def tables(self) -> np.ndarray:
        """Tables of each restaurant, those outside this shard and those of single customers included."""
        return self.others + np.bincount(self.restaurant, weights=self.t, minlength=len(self.others))

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        return self.size, self.own

    def move(self, c: np.ndarray, parent: np.ndarray, d: float, strength: float, rng) -> None:
        """All customers of every dish leave and sit down again.

        Given a gamma variable of strength / d + tables for each restaurant, its dishes are independent.  With ``rate`` the
        variable times the parent's probability, a dish has a Poisson number of tables of each size n, rate * d * (1 - d) ...
        (n - 1 - d) / n! on average, given that they hold its c customers.  Tables are dealt into groups at random, which
        keep their totals.  In each group the table of a random customer takes up the difference while all others are drawn
        anew; the step is accepted by the ratio of gamma(n - d) / gamma(n) * x ** n of that table (Metropolis and Hastings),
        x being the weight by which the draw prefers small tables.  The work is as the number of tables, not of customers.
        """
        if not self.dishes:
            return
        rate = parent * rng.gamma(strength / d + self.tables())[self.restaurant]
        gap, groups = _tilt(c, rate, d)
        key = (np.cumsum(groups) - groups)[self.own]
        key += (rng.random(len(key)) * groups[self.own]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        size, key = self.size[order], key[order]
        head = np.diff(key, prepend=-1) > 0
        first, group = np.flatnonzero(head), np.cumsum(head) - 1
        dish, total = self.own[order[first]], np.add.reduceat(size, first)
        at = np.searchsorted(np.cumsum(size), np.cumsum(total) - total + np.minimum((rng.random(len(first)) * total).astype(np.int64), total - 1), side="right")
        old = size[at]
        gap = np.maximum(gap[dish], 1 / (total + 1))
        log_x = np.log1p(-gap)
        owner = np.repeat(np.arange(len(first)), rng.poisson(rate[dish] / groups[dish] * (1 - gap)))
        with np.errstate(divide="ignore"):  # geometric with a beta chance of success
            n = 1 + np.minimum(rng.standard_exponential(len(owner)) / -np.log1p(-rng.beta(d, 1 - d, len(owner))), 1e15).astype(np.int64)
        kept = -rng.standard_exponential(len(owner)) < (n - 1) * log_x[owner]
        owner, n = owner[kept], n[kept]
        rest = total - np.bincount(owner, weights=np.minimum(n, total[owner]), minlength=len(first)).astype(np.int64)
        gain = _log_weight(np.maximum(rest, 1), d) - _log_weight(old, d) + (rest - old) * log_x
        changed = (rest > 0) & (-rng.standard_exponential(len(first)) < gain)
        stay, come = ~changed[group], changed[owner]
        self._set(np.concatenate([size[stay], rest[changed], n[come]]), dish[np.concatenate([group[stay], np.flatnonzero(changed), owner[come]])])


# ---- shards ----

LEARNT = ("shard int, words binary, per binary, w binary, c binary, m_u binary, m_w binary, m_words binary, m_c binary, m_single binary, "
          "tokens bigint, named bigint, pairs bigint, once bigint, twice bigint, split_c array<bigint>, split_t array<bigint>, "
          "pack bigint, word_at binary, word_seen binary, pair_at binary, pair_seen binary")
_KINDS = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
_LEARNT = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in LEARNT.split(", ")])


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in ascending keys."""
    at = np.searchsorted(keys, wanted)
    inside = np.minimum(at, max(len(keys) - 1, 0))
    return at, (keys[inside] == wanted if len(keys) else np.zeros(len(wanted), bool))


def learnt(requests: DataFrame, split: Split, shards: int) -> DataFrame:
    """For each shard one row with its contexts and pairs, their counts, and what its seating needs; and one row for each
    message (pack not null) that tells where the message's words and pairs are among those.

    Places are kept only of what was learnt; they ascend along a message's words, and along its pairs by (context, word),
    so they take about a byte each.
    """

    def merge(t: pa.Table) -> pa.Table:
        shard, parts = t["shard"][0].as_py(), []
        for words, per, w, n in zip(*(t[c].to_pylist() for c in ("words", "per", "w", "n")), strict=True):
            parts.append((np.repeat(np.concatenate([unpack(words, np.uint64), split.hashes]), unpack(per)), unpack(w, np.uint64), unpack(n)))
        u, w, n = (np.concatenate([x[i] for x in parts]) for i in range(3))
        source = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        del parts
        order = np.lexsort((w, u))
        u, w, n, source = u[order], w[order], n[order], source[order]
        head = np.ones(len(u), dtype=bool)
        head[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(head)
        total_of = np.add.reduceat(n, first) if len(first) else n
        kept = total_of > 0
        # of every request: the pair's place among those kept, in (context, word) order within its message
        group = np.cumsum(head) - 1
        place, seen = (np.cumsum(kept) - kept)[group], kept[group]
        by_source = np.argsort(source, kind="stable")
        edge = np.searchsorted(source[by_source], np.arange(len(t) + 1))
        u, w, c = u[first][kept], w[first][kept], total_of[kept]
        own_split = split.hashes[home(split.hashes, shards) == shard]
        words = np.unique(np.concatenate([u, own_split]))
        at = np.searchsorted(words, u)
        per = np.bincount(at, minlength=len(words))
        many = c > 1
        m_words, m_w = np.unique(w[many], return_inverse=True)
        hot = split.index(words)
        total = np.bincount(at, weights=c, minlength=len(words)).astype(np.int64)
        split_c, split_t = (np.bincount(hot[hot >= 0], weights=v[hot >= 0], minlength=len(split.hashes)).astype(np.int64) for v in (total, per))
        rows = [{"shard": shard, "words": pack(words), "per": pack(per), "w": pack(w), "c": pack(c),
                 "m_u": pack(at[many]), "m_w": pack(m_w), "m_words": pack(m_words), "m_c": pack(c[many]),
                 "m_single": pack(np.bincount(at[~many], minlength=len(words))),
                 "tokens": int(c.sum()), "named": int(((hot < 0) & (per > 0)).sum()), "pairs": len(c), "once": int((c == 1).sum()), "twice": int((c == 2).sum()),
                 "split_c": split_c.tolist(), "split_t": split_t.tolist()}]
        for i, (number, asked_words) in enumerate(zip(t["pack"].to_pylist(), t["words"].to_pylist(), strict=True)):
            mine = by_source[edge[i]:edge[i + 1]]
            word_at, word_seen = _found(words, unpack(asked_words, np.uint64))
            rows.append({"shard": shard, "pack": number, "word_at": ascending(word_at), "word_seen": pack(word_seen), "pair_at": ascending(place[mine]), "pair_seen": pack(seen[mine])})
        return pa.Table.from_pylist(rows, _LEARNT)

    return requests.groupBy("shard").applyInArrow(merge, LEARNT)


def _to_homes(shard: int, w: np.ndarray, values: list[np.ndarray], shards: int) -> list[dict]:
    """Messages of (word, value for each sample) to the words' home shards; words ascend in each."""
    to = (w % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(shards + 1))
    return [{"to": s, "src": shard, "w": pack(w[at]), "t": [pack(v[at]) for v in values]}
            for s in range(shards) if len(at := order[edge[s]:edge[s + 1]])]


TO_PARENT = "to int, src int, w binary, t array<binary>"
_TO_PARENT = pa.schema([("to", pa.int32()), ("src", pa.int32()), ("w", pa.binary()), ("t", pa.list_(pa.binary()))])


def first_tables(table: DataFrame, shards: int) -> DataFrame:
    """One table for every dish of every restaurant, by word (src -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("w"):
                w, n = np.unique(unpack(packed.as_py(), np.uint64), return_counts=True)
                yield pa.RecordBatch.from_pylist(_to_homes(-1, w, [n], shards), _TO_PARENT)

    return table.select("w").mapInArrow(run, TO_PARENT)


def counted(first: DataFrame) -> DataFrame:
    """The parent's customers if every dish has one table: (to, w, n) with one row for each shard, and their counts of counts."""
    kind = "to int, w binary, n binary, once bigint, twice bigint"

    def run(t: pa.Table) -> pa.Table:
        w, at = np.unique(np.concatenate([unpack(x, np.uint64) for x in t["w"].to_pylist()]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unpack(x[0]) for x in t["t"].to_pylist()])).astype(np.int64)
        return pa.table({"to": pa.array([t["to"][0].as_py()], pa.int32()), "w": pa.array([pack(w)], pa.binary()), "n": pa.array([pack(n)], pa.binary()),
                         "once": pa.array([int((n == 1).sum())]), "twice": pa.array([int((n == 2).sum())])})

    return first.groupBy("to").applyInArrow(run, kind)


@dataclass
class Facts:
    """Numbers of the whole corpus that every task needs."""

    shards: int
    tokens: int
    vocabulary: int
    tables: list[int]
    d: float
    d_parent: float
    split: Split
    split_c: np.ndarray
    split_t: list[np.ndarray]


PARENT = "shard int, src int, w binary, p array<binary>"


def parent(extra: DataFrame, root: DataFrame, facts: Facts, strength: float, seed: int, last: bool) -> DataFrame:
    """The parent's seating of all tables; rows (shard = who asked, src, p): its probabilities of the words asked for, for each sample.

    In the last round there is one row (src = -1) with the customers and tables of all of its words, for each sample, instead.
    """
    kinds = pa.schema([("shard", pa.int32()), ("src", pa.int32()), ("w", pa.binary()), ("p", pa.list_(pa.binary()))])

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(base):
            return kinds.empty_table()
        shard = base["to"][0].as_py()
        w, n = unpack(base["w"][0].as_py(), np.uint64), unpack(base["n"][0].as_py())
        places = [np.searchsorted(w, unpack(x, np.uint64)) for x in asked["w"].to_pylist()]
        given = asked["t"].to_pylist()
        out, customers, own_tables = [], [], []
        for s, all_tables in enumerate(facts.tables):
            c = n.copy()
            for at, t in zip(places, given, strict=True):
                c[at] += unpack(t[s])
            rng = np.random.default_rng([_SEED, seed, s, shard])
            many = c > 1
            t0 = np.ones(len(c), np.int64)
            if many.any():
                h = 1.0 / (facts.vocabulary + 1)
                p = np.full(many.sum(), h)
                seats = Seats(*start(c[many], (strength + facts.d_parent * facts.vocabulary) * p, p, facts.d_parent, rng), len(p),
                              np.zeros(len(p), np.int64), np.array([float(facts.vocabulary - many.sum())]))
                for _ in range(MOVES):
                    seats.move(c[many], p, facts.d_parent, strength, rng)
                t0[many] = seats.t
            out.append(parent_p(c, t0, facts, strength, all_tables))
            customers.append(c)
            own_tables.append(t0)
        if last:
            return pa.Table.from_pylist([{"shard": shard, "src": -1, "w": pack(w), "p": samples_of(customers) + samples_of(own_tables)}], kinds)
        return pa.Table.from_pylist([{"shard": to, "src": shard, "w": b"", "p": [x[at].astype(np.float32).tobytes() for x in out]}
                                     for to, at in zip(asked["src"].to_pylist(), places, strict=True)], kinds)

    return root.groupBy("to").cogroup(extra.groupBy("to")).applyInArrow(run, PARENT)


def parent_p(c: np.ndarray, t: np.ndarray, facts: Facts, strength: float, all_tables: int) -> np.ndarray:
    """The parent's probability of words with c customers at t tables; what it gives to its base counts its tables as one for each word."""
    base = (strength + facts.d_parent * facts.vocabulary) / (facts.vocabulary + 1)
    return (c - facts.d_parent * t + base) / (strength + all_tables)


SEATED = "shard int, sizes binary, owners binary, words binary, extra array<binary>, sums binary, tables array<binary>, n_extra array<bigint>, split_t array<array<bigint>>"


def seat(table: DataFrame, answers: DataFrame, seats: DataFrame | None, facts: Facts, strength: float, seed: int, samples: int) -> DataFrame:
    """A round of Gibbs sweeps in every shard, given the parent's probabilities; ``samples`` states of it are kept."""
    kinds = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("sizes", "owners", "words")], ("extra", pa.list_(pa.binary())), ("sums", pa.binary()),
                       ("tables", pa.list_(pa.binary())), ("n_extra", pa.list_(pa.int64())), ("split_t", pa.list_(pa.list_(pa.int64())))])
    own = table.select("shard", F.lit(0).alias("kind"), F.array("words", "m_u", "m_w", "m_words", "m_c", "m_single").alias("x"), F.lit(-1).alias("src"))
    rows = own.union(answers.select("shard", F.lit(1), F.col("p"), "src"))
    if seats is not None:
        rows = rows.union(seats.select("shard", F.lit(2), F.array("sizes", "owners"), F.lit(-1)))

    def run(t: pa.Table) -> pa.Table:
        kind, x, src = (t[c].to_pylist() for c in ("kind", "x", "src"))
        mine = [v for k, v in zip(kind, x, strict=True) if k == 0]
        if not mine:
            return kinds.empty_table()
        names, words = unpack(mine[0][0], np.uint64), unpack(mine[0][3], np.uint64)
        u, w, c, single = (unpack(mine[0][i]) for i in (1, 2, 4, 5))
        # answers come by the words' home shards, in ascending order of the word
        order = np.argsort((words % np.uint64(facts.shards)).astype(np.int64), kind="stable")
        p = np.empty(len(words))
        got = sorted((s, v[0]) for k, v, s in zip(kind, x, src, strict=True) if k == 1)
        if len(words):
            p[order] = np.concatenate([np.frombuffer(v, np.float32) for _, v in got])
        others = single.astype(float)
        hot = facts.split.index(names)
        held = [v for k, v in zip(kind, x, strict=True) if k == 2]
        rng = np.random.default_rng([_SEED, seed, 99, t["shard"][0].as_py()])
        if held:
            size, who = unpack(held[0][0]), unpack(held[0][1])
        else:
            size, who = start(c, (strength + facts.d * np.maximum(others[u], 1)) * p[w], p[w], facts.d, rng) if len(c) else (c, c)
        if (hot >= 0).any():  # tables of a split context in other shards, as they were last counted
            here = others + np.bincount(u, minlength=len(names)) if not held else others + np.bincount(u[who], minlength=len(names))
            others[hot >= 0] += np.maximum(facts.split_t[-1][hot[hot >= 0]] - here[hot >= 0], 0)
        seats_ = Seats(size, who, len(c), u, others)
        extra, sums, tables, n_extra, split_t = [], np.zeros(len(c), np.int64), [], [], []
        for k in range(max(samples, 1)):
            for _ in range(MOVES * (1 if samples else SWEEPS)):
                if len(c):
                    seats_.move(c, p[w], facts.d, strength, rng)
            more = np.bincount(w, weights=seats_.t - 1, minlength=len(words)).astype(np.int64)
            own_t = single + np.bincount(u, weights=seats_.t, minlength=len(names)).astype(np.int64)
            extra.append(pack(more))
            n_extra.append(int(more.sum()))
            sums += seats_.t
            tables.append(own_t)
            split_t.append(np.bincount(hot[hot >= 0], weights=own_t[hot >= 0], minlength=len(facts.split.hashes)).astype(np.int64).tolist())
        size, who = seats_.taken()
        return pa.Table.from_pylist([{"shard": t["shard"][0].as_py(), "sizes": pack(size), "owners": pack(who), "words": pack(words), "extra": extra,
                                      "sums": pack(sums), "tables": samples_of(tables), "n_extra": n_extra, "split_t": split_t}], kinds)

    return rows.groupBy("shard").applyInArrow(run, SEATED)


def asked(words: DataFrame, extra: Column, shards: int) -> DataFrame:
    """Messages of (shard, words, extra tables of each sample) to the parent's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, w, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names = unpack(w, np.uint64)
                values = [unpack(x) for x in more] if more else [np.zeros(len(names), np.int64)]
                yield pa.RecordBatch.from_pylist(_to_homes(shard, names, values, shards), _TO_PARENT)

    return words.select("shard", "words", extra.alias("extra")).mapInArrow(run, TO_PARENT)


# ---- answers and scores ----

REPLIES = "pack bigint, shard int, count binary, tables array<binary>, customers array<binary>, above array<binary>, c binary, t binary"


def replies(table: DataFrame, seats: DataFrame, root: DataFrame) -> DataFrame:
    """For each message of a pack: by word its count, its tables, and its customers and tables at the parent (for each sample);
    by pair its count and the tables beyond one (summed over samples)."""
    kinds = pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("count", pa.binary()), *[(c, pa.list_(pa.binary())) for c in ("tables", "customers", "above")],
                       ("c", pa.binary()), ("t", pa.binary())])
    none = F.lit(None).cast("bigint")
    rows = (table.where("pack IS NULL").select("shard", none.alias("pack"), F.array("words", "per", "c").alias("x"), F.lit(0).alias("kind"))
            .union(seats.select("shard", none, F.concat(F.array("sums"), F.col("tables")), F.lit(1)))
            .union(root.select("shard", none, F.concat(F.array("w"), F.col("p")), F.lit(2)))
            .union(table.where("pack IS NOT NULL").select("shard", "pack", F.array("word_at", "word_seen", "pair_at", "pair_seen"), F.lit(3))))

    def run(t: pa.Table) -> pa.Table:
        kind, x, packs_ = (t[c].to_pylist() for c in ("kind", "x", "pack"))
        of = lambda k: next((v for j, v in zip(kind, x, strict=True) if j == k), None)
        own, state, base = of(0), of(1), of(2)
        if own is None:
            return kinds.empty_table()
        words, per, c = (unpack(b, k) for b, k in zip(own, (np.uint64, np.int64, np.int64), strict=True))
        extra = np.zeros(len(c), np.int64)
        extra[c > 1] = unpack(state[0]) - SAMPLES
        count = np.bincount(np.repeat(np.arange(len(words)), per), weights=c, minlength=len(words)).astype(np.int64)
        named = unpack(base[0], np.uint64) if base else np.empty(0, np.uint64)
        at, there = _found(named, short(words))
        at[~there] = 0
        by_word = [each_sample(state[1:]), *([np.where(there, v[at], 0) for v in each_sample(b)] if base else [np.zeros(len(words), np.int64)] * SAMPLES
                                             for b in ((base[1:1 + SAMPLES], base[1 + SAMPLES:]) if base else (None, None)))]

        def take(values: np.ndarray, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            out[seen] = values[at[seen]]
            return out
        out = []
        for number, k, v in zip(packs_, kind, x, strict=True):
            if k == 3:
                w_at, w_seen, p_at, p_seen = np.cumsum(unpack(v[0])), unpack(v[1], bool), np.cumsum(unpack(v[2])), unpack(v[3], bool)
                out.append({"pack": number, "shard": t["shard"][0].as_py(), "count": pack(take(count, w_at, w_seen)), "c": pack(take(c, p_at, p_seen)), "t": pack(take(extra, p_at, p_seen))}
                           | {name: samples_of([take(s, w_at, w_seen) for s in samples]) for name, samples in zip(("tables", "customers", "above"), by_word, strict=True)})
        return pa.Table.from_pylist(out, kinds)

    return rows.groupBy("shard").applyInArrow(run, REPLIES)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(table: DataFrame, answers: DataFrame, facts: Facts, strength: float) -> DataFrame:
    """Rows of the documents of each pack."""
    none = F.lit(None).cast("int")
    own = table.select("pack", none.alias("shard"), F.array("ids", "fold", "counts", "words", "stream").alias("x"))
    rows = own.union(answers.select("pack", "shard", F.concat(F.array("count", "c", "t"), "tables", "customers", "above")))

    def run(t: pa.Table) -> pa.Table:
        shard, x = t["shard"].to_pylist(), t["x"].to_pylist()
        ids, fold, counts, words, stream = next(v for s, v in zip(shard, x, strict=True) if s is None)
        p = Pairs(words, stream, counts, fold, facts.split, facts.shards)
        got = [v for _, v in sorted(((s, v) for s, v in zip(shard, x, strict=True) if s is not None), key=lambda v: v[0])]

        def by_word(values: list[np.ndarray]) -> np.ndarray:
            out = np.empty(len(p.words))
            out[p.by_home] = np.concatenate(values)
            return out
        count = by_word([unpack(v[0]) for v in got]).astype(np.int64)
        split_at = facts.split.index(p.words)
        is_split = split_at >= 0
        count[is_split] = facts.split_c[split_at[is_split]]
        # a message's answers are in (context, word) order
        in_order = np.lexsort((p.distinct, p.shard_of))
        c, t_sum = np.empty(len(p.distinct)), np.empty(len(p.distinct))
        c[in_order], t_sum[in_order] = (np.concatenate([unpack(v[i]) for v in got]) for i in (1, 2))
        t_sum += SAMPLES * (c > 0)
        parts = [[each_sample(v[a:a + SAMPLES]) for v in got] for a in (3, 3 + SAMPLES, 3 + 2 * SAMPLES)]
        u = p.distinct // len(p.words)
        # the mean over samples of what the parent gives; what dishes have of their own is linear in the tables
        passed, plain = np.zeros(len(u)), np.zeros(len(u))
        for s in range(SAMPLES):
            tables, customers, above = (by_word([v[s] for v in part]) for part in parts)
            tables[is_split] = facts.split_t[s][split_at[is_split]]
            above_p = parent_p(customers, above, facts, strength, facts.tables[s])[p.w]
            passed += (strength + facts.d * tables[u]) * above_p / SAMPLES
            plain += above_p / SAMPLES
        open_ = count[u] > 0
        pair = np.log10(np.where(open_, (c - facts.d * t_sum / SAMPLES + passed) / (strength + count[u]), plain))
        row = np.repeat(np.arange(len(p.counts)), p.counts)
        n = len(p.counts)
        single = np.log10((count + 0.5) / (facts.tokens + 0.5 * (facts.vocabulary + 1)))
        by_row = lambda v: np.bincount(row, weights=v, minlength=n)
        return pa.table({
            "doc_id": pa.array(np.frombuffer(ids, np.int64), mask=p.fold == 2), "held_out": pa.array(p.fold == 1, mask=p.fold == 2), "n_tokens": pa.array(p.counts),
            "n_known": pa.array(by_row(count[p.token] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, facts.tokens, np.int64)),
            "base_score": pa.array(by_row(single[p.token])), "score": pa.array(by_row(pair[np.searchsorted(p.distinct, p.key)]))})

    return rows.groupBy("pack").applyInArrow(run, SCORES)


def _discount(once: int, twice: int) -> float:
    """From the counts of counts, as absolute discounting has it."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice else 0.5


def score_texts(df: DataFrame, held: Column, key: str = "doc_id", text: str = "text", strength: float = STRENGTH) -> DataFrame:
    """One row per row of ``df``: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from rows for which ``held`` is false.
    """
    need(df, key, text)
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size // 6) // SHARD))
    table = cut_lineage(packs(docs, shards), "lm-packs")
    # contexts above a shard's share of the tokens: fewer than there are shards
    tokens = table.agg(F.sum("tokens")).first()[0] or 0
    tops = (table.select(F.explode("top").alias("x")).groupBy("x.h").agg(F.sum("x.n").alias("n")).where(F.col("n") * shards >= tokens)
            .select("h", F.ceil(F.col("n") * 2 * shards / max(tokens, 1)).alias("sections"))).collect()
    tops = sorted((np.uint64(r.h & (1 << 64) - 1), min(int(r.sections), shards)) for r in tops)
    split = Split(np.array([h for h, _ in tops], np.uint64), np.array([s for _, s in tops], np.int64))

    both = cut_lineage(learnt(messages(table, split, shards), split, shards), "lm-counts")
    model = both.where("pack IS NULL")
    facts_row = model.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "named", "pairs", "once", "twice")]).first()
    per_split = lambda frame, column: {r.i: r.n for r in frame.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    as_array = lambda d: np.array([d.get(i, 0) for i in range(len(split.hashes))], np.int64)
    split_c, split_t = as_array(per_split(model, F.col("split_c"))), as_array(per_split(model, F.col("split_t")))
    vocabulary = facts_row.named + int((split_c > 0).sum())
    root = cut_lineage(counted(first_tables(model, shards)), "lm-parent")
    parent_counts = root.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    n_pairs = facts_row.pairs
    facts = Facts(shards, facts_row.tokens, vocabulary, [n_pairs], _discount(facts_row.once, facts_row.twice), _discount(*parent_counts), split, split_c, [split_t])

    def after(seats: DataFrame, samples: int) -> Facts:
        """The facts once the parent has got all tables of these seatings."""
        extra = seats.agg(*[F.coalesce(F.sum(F.col("n_extra")[s]), F.lit(0)) for s in range(samples)]).first()
        tables = [as_array(per_split(seats, F.col("split_t")[s])) for s in range(samples)]
        return replace(facts, tables=[n_pairs + n for n in extra], split_t=tables)

    # first the parent with one table for each dish, then contexts and parent in turn; the last round keeps its states
    answers = parent(asked(model.select("shard", F.col("m_words").alias("words")), F.array().cast("array<binary>"), shards), root, facts, strength, 0, False)
    seats, now = None, facts
    for k in range(BURN + 1):
        samples = SAMPLES if k == BURN else 0
        seats = cut_lineage(seat(model, answers, seats, now, strength, k + 1, samples), "lm-seats")
        now = after(seats, max(samples, 1))
        answers = parent(asked(seats, F.col("extra"), shards), root, now, strength, k + 1, k == BURN)
    answers = cut_lineage(answers, "lm-parent-end")
    return scored(table, replies(both, seats, answers), now, strength)


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
