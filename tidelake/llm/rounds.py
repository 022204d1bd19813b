"""Questions that batches of documents ask of the whole corpus, and their answers.

Documents are dealt into batches by id hash, of about equal size. In a round each
batch names the keys that it holds, each once; keys of all batches meet by value;
each batch gets a few bits back for each of its keys, in the order of its keys.
What is sent for a very frequent key so grows with the batches, not with its rows.
Batches are worked out anew in each round from the same exchange of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASKED = "bucket int, batch int, kind int, keys binary, more binary"
ANSWERED = "batch int, bucket int, kind int, bits binary"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the two rolling hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, kept by the worker for its next batch."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 20)
        known = tuple(np.full(size, x, np.uint64) for x in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        for x in known:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if size <= 1 << 23:
            _POWERS[int(base)] = known
    return known


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values in constant time each."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values) + 1
        forth, self.back = powers(base, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * forth[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, lo: int, hi: int, length: int) -> np.ndarray:
        """Of the stretches of this length that start at lo to hi - 1; high bits are as good as of()'s, low bits are not."""
        return (self.sums[lo + length : hi + length] - self.sums[lo:hi]) * self.back[lo:hi]


def batched(docs: DataFrame, text: Column, batch_bytes: int, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """(batch, doc_id, text as bytes) and how many buckets keys are to meet in.

    A batch holds about batch_bytes of text, a bucket the keys of about bucket_bytes.
    A batch sends a row to each bucket, so for very large inputs both are raised
    together: rows then follow the input as long as a batch has a few keys a bucket.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    batches = max(1, -(-total // batch_bytes))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // bucket_bytes), min(batches, partitions))
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", text.cast("binary").alias("text")), buckets


def columns(table: pa.Table) -> tuple[list, list]:
    """(ids, texts) of a batch, in order of id (null first), then text."""
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest bytes and so on: high bytes that are all alike then compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end in sorted keys."""
    step = (1 << 64) // buckets
    return np.concatenate([[0], np.searchsorted(keys, np.array([step * b for b in range(1, buckets)], np.uint64)), [len(keys)]])


def asked(batch: int, kind: int, keys: np.ndarray, more: list[np.ndarray], buckets: int) -> list[tuple]:
    """Rows of ASKED for sorted distinct keys; more: what goes with each key, one array or several."""
    cut, out = edges(keys, buckets), []
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            out.append((b, batch, kind, keys[lo:hi].tobytes(), b"".join(planes(m[lo:hi]) for m in more)))
    return out


def asked_table(rows: list[tuple]) -> pa.Table:
    names, kinds = ("bucket", "batch", "kind", "keys", "more"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def answered_table(rows: list[tuple]) -> pa.Table:
    names, kinds = ("batch", "bucket", "kind", "bits"), (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def answer(questions: DataFrame, reply) -> DataFrame:
    """reply(kind, owner, batch of each owner, keys, more of each owner) gives a byte for each key; a bucket's keys meet in one task."""

    def bucket(table: pa.Table) -> pa.Table:
        out, kinds = [], np.array(table["kind"].to_pylist(), int)
        for kind in np.unique(kinds):
            part = table.filter(pa.array(kinds == kind))
            keys = [np.frombuffer(k, np.uint64) for k in part["keys"].to_pylist()]
            sizes = np.array([len(k) for k in keys])
            batches = np.array(part["batch"].to_pylist(), np.int64)
            bits = reply(int(kind), np.repeat(np.arange(len(keys)), sizes), batches, np.concatenate(keys), part["more"].to_pylist())
            at, number = np.concatenate([[0], np.cumsum(sizes)]), part["bucket"][0].as_py()
            out += [(int(batches[k]), number, int(kind), np.packbits(bits[at[k] : at[k + 1]].astype(np.uint8)).tobytes() if bits.ndim == 1 else b"".join(np.packbits(bits[at[k] : at[k + 1], c]).tobytes() for c in range(bits.shape[1]))) for k in range(len(keys))]
        return answered_table(out)

    return questions.groupBy("bucket").applyInArrow(bucket, ANSWERED)


def answers_of(table: pa.Table, kind: int, keys: np.ndarray, buckets: int, width: int = 1) -> np.ndarray:
    """The bits [keys, width] that came back for a batch's sorted keys of a kind."""
    out, cut = np.zeros((len(keys), width), bool), edges(keys, buckets)
    for b, k, bits in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["bits"].to_pylist(), strict=True):
        if k == kind:
            lo, hi = cut[b], cut[b + 1]
            data = np.frombuffer(bits, np.uint8).reshape(width, -1)
            for c in range(width):
                out[lo:hi, c] = np.unpackbits(data[c], count=hi - lo)
    return out


def groups(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number in that order) of equal rows; the last array counts most."""
    order = np.lexsort(by)
    new = np.zeros(len(order), bool)
    for x in by:
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, np.cumsum(new)
