"""LM scoring by masked pseudo-likelihood.

A window network sees the two tokens on each side of a place and predicts the
token in it; a text's score is the sum of the log-probabilities of all its tokens,
each given its neighbours. Everything it learns comes from the whole corpus. The
network knows the commonest words and buckets of all others; each partition trains
a copy of it on all of its places, masked in turn, and copies are averaged by the
places they saw (iterative parameter mixing, McDonald et al. 2010).
The counts of all words, a table that grows with the corpus, tell the words of a
bucket apart: P(word | neighbours) = P(bucket | neighbours) n(word) / n(bucket).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, keyed_text
from .rounds import ANSWERED, ASKED, answered_table, asked, asked_table, batched, columns, edges, from_planes, planes

SIDES = (-2, -1, 1, 2)
#: Token ids: 0 stands outside the text, then the WORDS commonest words, then BUCKETS of all others by hash.
WORDS, BUCKETS = 767, 256
IDS, CLASS = 1 + WORDS + BUCKETS, 32
WIDTH = 16
#: Places of one step of training, and of one step of scoring.
STEP, SCORED = 7168, 8192

#: Codes of words beyond the commonest have this bit and 63 bits of hash.
RARE = 1 << 63


#: Base of the polynomial that hashes words, and its inverse modulo 2^64; how many bytes are hashed at once.
_BASE = 0x9E6C63D0876A9A35
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = 1 << 19
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
#: What else str.split() takes for space.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^n powers of the base and of its inverse."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << n) - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))


def _hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some bytes, and where it starts: its bytes as digits of a number, whose bits are then mixed."""
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    start, stop = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    power, inverse = _powers(max(len(data), _BYTES).bit_length())
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=upto[1:])
    h = (upto[stop] - upto[start]) * inverse[start]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) | np.uint64(RARE), start


def hashed(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words, in small letters, of all texts one after the other, and how many each text has; the bytes of many texts are looked at together."""
    plain = [t if t.isascii() else _WIDE.sub(" ", t) for t in map(str.lower, texts)]
    parts = [t.encode("utf-8", "surrogatepass") for t in plain]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b" ".join(parts), np.uint8)
    space = _SPACE[data]
    codes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        # A word is not cut: a piece ends with the next space.
        until = at + _BYTES
        while until < len(data) and not (found := space[until : until + _BYTES]).any():
            until += _BYTES
        until = until + int(found.argmax()) if until < len(data) else len(data)
        h, start = _hashes(data[at:until], space[at:until])
        codes.append(h), places.append(at + start)
        at = until
    return np.concatenate(codes), np.bincount(np.searchsorted(ends, np.concatenate(places), "right"), minlength=len(texts))


def code_of(word: str) -> int:
    return int(hashed([word])[0][0])


class Vocabulary:
    """Code of each word: the id of a common one, else its hash."""

    def __init__(self, common: tuple[int, ...]):
        codes = np.array(common, np.uint64)
        self.ids = np.append(np.argsort(codes).astype(np.uint64) + np.uint64(1), np.uint64(0))
        self.known = np.append(np.sort(codes), np.uint64(0))

    def coded(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of texts, and how many each text has."""
        codes, sizes = hashed(texts)
        at = np.searchsorted(self.known[:-1], codes)
        return np.where(self.known[at] == codes, self.ids[at], codes), sizes

    def codes(self, text: str) -> np.ndarray:
        return self.coded([text])[0]


def ids_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < RARE, codes, 1 + WORDS + (codes & np.uint64(BUCKETS - 1))).astype(np.int64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The 63 bits of hash as numbers spread over all of 64 bits."""
    return codes << np.uint64(1)


def padded(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one row, with as many zeros between two texts as a window reaches, and where each id is."""
    reach = max(SIDES)
    at = np.arange(len(ids)) + reach * (1 + np.repeat(np.arange(len(sizes)), sizes))
    out = np.zeros(len(ids) + reach * (len(sizes) + 1), np.int64)
    out[at] = ids
    return out, at


def contexts(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[places, sides] of neighbours' ids."""
    return np.stack([row[at + s] for s in SIDES], 1)


@dataclass
class Network:
    """Embeddings gated by side, a tanh layer, then the class of the token and the token within its class."""

    parts: dict[str, np.ndarray]

    @classmethod
    def initial(cls, counts: np.ndarray, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        share = (counts + 0.5).reshape(-1, CLASS)
        return cls({
            "embedding": draw(IDS, WIDTH), "gate": 1 + draw(len(SIDES), WIDTH), "shift": np.zeros(WIDTH, np.float32),
            "class": draw(WIDTH, IDS // CLASS), "class_bias": np.log(share.sum(1) / share.sum()).astype(np.float32),
            "member": draw(IDS // CLASS, WIDTH, CLASS), "member_bias": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        })

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def unpacked(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, v in self.parts.items():
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Network(out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        p = self.parts
        seen = sum((p["embedding"] * p["gate"][s])[context[:, s]] for s in range(len(SIDES)))
        return np.tanh(seen + p["shift"])

    @staticmethod
    def by_class(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of places by the class of their tokens, where classes begin and end in it, and tokens within their class in that order."""
        kind = (token // CLASS).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        return order, np.searchsorted(kind[order], np.arange(IDS // CLASS + 1)), (token % CLASS)[order]

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        p = self.parts
        order, cut, member = self.by_class(token)
        h = self.hidden(context)[order]

        def log_share(z: np.ndarray, right: np.ndarray) -> np.ndarray:
            z -= z.max(1, keepdims=True)
            chosen = z[np.arange(len(z)), right]
            return chosen - np.log(np.exp(z, out=z).sum(1))

        out = log_share(h @ p["class"] + p["class_bias"], token[order] // CLASS)
        for k in np.flatnonzero(np.diff(cut)):
            at = slice(cut[k], cut[k + 1])
            out[at] += log_share(h[at] @ p["member"][k] + p["member_bias"][k], member[at])
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradient(self, context: np.ndarray, token: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-probability."""
        p, n = self.parts, len(token)
        order, cut, member = self.by_class(token)
        h = self.hidden(context)[order]
        g = {k: np.zeros_like(v) for k, v in p.items()}

        def residual(z: np.ndarray, right: np.ndarray) -> np.ndarray:
            z -= z.max(1, keepdims=True)
            e = np.exp(z, out=z)
            e /= -e.sum(1, keepdims=True) * n
            e[np.arange(len(z)), right] += 1 / n
            return e

        d = residual(h @ p["class"] + p["class_bias"], token[order] // CLASS)
        g["class"], g["class_bias"] = h.T @ d, d.sum(0)
        dh = d @ p["class"].T
        for k in np.flatnonzero(np.diff(cut)):
            at = slice(cut[k], cut[k + 1])
            d = residual(h[at] @ p["member"][k] + p["member_bias"][k], member[at])
            g["member"][k], g["member_bias"][k] = h[at].T @ d, d.sum(0)
            dh[at] += d @ p["member"][k].T
        dh *= 1 - h * h
        g["shift"] = dh.sum(0)
        for s in range(len(SIDES)):
            ids = context[order, s].astype(np.int16)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[by], prepend=-1))
            some, sums = ids[by[first]], np.add.reduceat(dh[by], first)
            g["embedding"][some] += sums * p["gate"][s]
            g["gate"][s] = (sums * p["embedding"][some]).sum(0)
        return g

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.1) -> tuple[Network, int]:
        """A trained copy (AdaGrad) and how many places it saw."""
        out = Network({k: v.copy() for k, v in self.parts.items()})
        past, seen = {k: np.full_like(v, 1e-6) for k, v in out.parts.items()}, 0
        for context, token in batches:
            for k, g in out.gradient(context, token).items():
                past[k] += g * g
                out.parts[k] += rate * g / np.sqrt(past[k])
            seen += len(token)
        return out, seen


@dataclass(frozen=True)
class Model:
    """Codes of the commonest words, the count of every id, the network, and (key, n) of every word as a table."""

    common: tuple[int, ...]
    totals: np.ndarray
    network: Network
    counts: DataFrame


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
    """Texts in groups of about as many letters as are hashed at once."""
    held, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(text)
            size += len(text)
            if size >= _BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n) of every word of all texts; each task adds up before the shuffle."""
    bounded_batches(docs.sparkSession)

    def as_rows(codes: list[np.ndarray]) -> pd.DataFrame:
        key, n = np.unique(np.concatenate(codes), return_counts=True)
        return pd.DataFrame({"key": keys_of(key).view(np.int64), "n": n.astype(np.int64)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.uint64)]
        for texts in grouped(batches):
            held.append(hashed(texts)[0])
            if sum(map(len, held)) > 2_000_000:
                yield as_rows(held)
                held = [np.zeros(0, np.uint64)]
        yield as_rows(held)

    return docs.select("text").mapInPandas(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def statistics(counts: DataFrame) -> tuple[tuple[int, ...], np.ndarray]:
    """The commonest words (ties by key) and the count of every id."""
    common = [(r["key"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "key").limit(WORDS).collect()]
    number = F.shiftrightunsigned("key", 1).bitwiseAND(BUCKETS - 1).cast("int")
    n = np.zeros(IDS)
    for r in counts.groupBy(number.alias("b")).agg(F.sum("n").alias("n")).collect():
        n[1 + WORDS + r["b"]] = r["n"]
    codes = [(key % (1 << 64)) >> 1 | RARE for key, _ in common]
    for k, (code, (_, count)) in enumerate(zip(codes, common, strict=True)):
        n[k + 1] = count
        n[1 + WORDS + (code & (BUCKETS - 1))] -= count
    return tuple(codes), n


def fit(docs: DataFrame, scratch: Scratch, rounds: int = 1) -> Model:
    """A model of all texts; its table of words lies in scratch and goes with it.

    Memory: one network (about 0.15 MB) a task; sums go through 64 groups of tasks.
    No texts or no words: a model that gives every id the same probability.
    """
    docs = keyed_text(docs)
    counts = scratch.store(count_words(docs))
    common, totals = statistics(counts)
    network = Network.initial(totals)
    for _ in range(rounds):
        network = mixed_round(docs, common, network)
    return Model(common, totals, network, counts)


def mixed_round(docs: DataFrame, common: tuple[int, ...], start: Network) -> Network:
    """The mean, by places, of copies that each task trains on every place of its texts."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((common, start))

    def places(batches: Iterator[pd.DataFrame], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held_context, held_token, held = [], [], 0
        for texts in grouped(batches):
            codes, sizes = words.coded(texts)
            ids = ids_of(codes)
            row, at = padded(ids, sizes)
            for a in range(0, len(ids), STEP):
                part = at[a : a + STEP]
                held_context.append(contexts(row, part)), held_token.append(row[part])
                held += len(part)
                if held >= STEP:
                    c, t = np.concatenate(held_context), np.concatenate(held_token)
                    yield c[:STEP], t[:STEP]
                    held_context, held_token, held = [c[STEP:]], [t[STEP:]], held - STEP
        if held:
            yield np.concatenate(held_context), np.concatenate(held_token)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, network = shared.value
        out, seen = network.train(places(batches, Vocabulary(common)))
        if seen:
            yield pd.DataFrame({"key": [TaskContext.get().partitionId() % 4096], "n": [seen], "sums": [(out.packed().astype(np.float64) * seen).astype(np.float32).tobytes()]})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(len(np.frombuffer(part["sums"].iloc[0], np.float32)))
        for x in part["sums"]:
            sums += np.frombuffer(x, np.float32)
        return pd.DataFrame({"key": [int(part["key"].iloc[0]) % 64], "n": [part["n"].sum()], "sums": [sums.astype(np.float32).tobytes()]})

    schema = "key int, n long, sums binary"
    rows = docs.select("text").mapInPandas(trained, schema).groupBy("key").applyInPandas(added, schema).groupBy("key").applyInPandas(added, schema).collect()
    shared.unpersist()
    if not rows:
        return start
    total = sum(r["n"] for r in rows)
    return start.unpacked(sum(np.frombuffer(r["sums"], np.float32).astype(np.float64) for r in sorted(rows, key=lambda r: r["key"])) / total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over all tokens) and mean_log_prob of every whole text.

    A batch of texts asks the table of words for the counts of its uncommon words,
    each once. A word that the model's corpus lacks counts as one that occurs once.
    Null or empty text: 0 tokens, log_prob 0, mean_log_prob null. Rows that repeat
    give equal rows; other columns are not read. Very long texts are read whole, each
    by itself; batch_bytes bounds what other texts are worked on at once.
    """
    dealt, buckets = batched(keyed_text(docs, id_col, text_col), F.col("text"), batch_bytes)
    depth = (buckets - 1).bit_length()
    buckets = 1 << depth
    shared = docs.sparkSession.sparkContext.broadcast((model.common, model.network, np.log(np.maximum(model.totals, 1))))

    def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return Vocabulary(shared.value[0]).coded([t.decode() for t in texts])

    def asks(table: pa.Table) -> pa.Table:
        codes, _ = read(table["text"].to_pylist())
        return asked_table(asked(table["batch"][0].as_py(), 0, np.unique(keys_of(codes[codes >= RARE])), [], buckets))

    def told(questions: pa.Table, known: pa.Table) -> pa.Table:
        keys = known["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, n = np.append(keys[order], np.uint64(2**64 - 1)), np.append(known["n"].to_numpy()[order], 1)
        out = []
        for batch, bucket, wanted in zip(*[questions[c].to_pylist() for c in ("batch", "bucket", "keys")], strict=True):
            wanted = np.frombuffer(wanted, np.uint64)
            at = np.searchsorted(keys, wanted)
            out.append((batch, bucket, 0, planes(np.where(keys[at] == wanted, n[at], 1))))
        return answered_table(out)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        _, network, totals = shared.value
        names, texts = columns(table)
        codes, sizes = read(texts)
        rare = np.flatnonzero(codes >= RARE)
        keys, place = np.unique(keys_of(codes[rare]), return_inverse=True)
        counts, cut = np.ones(len(keys), np.int64), edges(keys, buckets)
        for bucket, data in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            counts[cut[bucket] : cut[bucket + 1]] = from_planes(data, np.int64)
        token = ids_of(codes)
        logs = np.zeros(len(token))
        logs[rare] = np.log(counts)[place] - totals[token[rare]]
        row, at = padded(token, sizes)
        for a in range(0, len(token), SCORED):
            part = slice(a, a + SCORED)
            logs[part] += network.log_probabilities(contexts(row, at[part]), token[part])
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))
        return pa.table([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total, pa.float64())], schema=schema)

    by_batch = dealt.groupBy("batch")
    bucket = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    known = model.counts.select(bucket.alias("bucket"), "key", "n").groupBy("bucket")
    answers = by_batch.applyInArrow(asks, ASKED).groupBy("bucket").cogroup(known).applyInArrow(told, ANSWERED)
    out = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(scored, "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
