"""Exact deduplication with a cuckoo-filter index over text digests.

Texts are equal when they are identical after every run of ASCII white space is one space. Each row's digest (SHA-256
of the normalised UTF-8 text) is computed by built-in functions in one scan and cut to the shared folder; texts are
never shuffled. Every input partition first folds its own repeats (so that a hot text arrives once per partition, not
once per row), then digests are dealt by value to index shards, in order within each. A shard's cuckoo filter answers "seen
before?" from 16-bit fingerprints; a hit is verified against the full digests stored with the bucket's slots; an
insertion that finds no room doubles the table and fills it again from the stored keys. As digests come in order, those
of a range are complete when a later one arrives: every ``RANGE_MOST`` digests the range is passed on and deleted from
the filter, so that an index holds a range and never a shard, however large that is. Digests whose live count has fallen
to nought are deleted and not passed on.

Nulls: a null text is empty; a null id ranks after all others (any long is a legal id). Rows that repeat id and text:
one of them stays. Texts of any length are digested whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep_rows, parts, table

SLOTS, KICKS = 4, 200
#: Digests that a partition folds before it passes them on.
FOLD_MOST = 200_000
#: Digests that an index shard holds at a time.
RANGE_MOST = 200_000
#: Ranks of ids: real ones by value, then null, then those of deleted rows.
REAL, NULL, GONE = 0, 1, 2


class CuckooIndex:
    """Live digests with a record each; ``find`` asks the fingerprints first and then verifies the stored digest."""

    def __init__(self, capacity: int = 1024):
        self.n = 1 << max(2, (capacity * 5 // 4 // SLOTS).bit_length())
        self.marks: list[int] = [0] * (self.n * SLOTS)
        self.entries: list[tuple[bytes, object] | None] = [None] * (self.n * SLOTS)
        self.size = self.resizes = 0

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[2:10], "little") % self.n

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 % self.n)

    def _slot(self, digest: bytes) -> int:
        """The slot that holds the digest, or -1."""
        mark, home = self._mark(digest), self._home(digest)
        for bucket in (home, self._other(home, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.entries[slot][0] == digest:
                    return slot
        return -1

    def find(self, digest: bytes):
        slot = self._slot(digest)
        return self.entries[slot][1] if slot >= 0 else None

    def replace(self, digest: bytes, record) -> None:
        self.entries[self._slot(digest)] = (digest, record)

    def insert(self, digest: bytes, record) -> None:
        """Adds a digest that is not in the index yet."""
        self.size += 1
        while (left := self._place((digest, record))) is not None:
            digest, record = left
            self._resize()

    def _place(self, entry):
        mark = self._mark(entry[0])
        bucket = self._home(entry[0])
        if not self._free(bucket, mark, entry):
            bucket = self._other(bucket, mark)
            for kick in range(KICKS):
                if self._free(bucket, mark, entry):
                    return None
                slot = bucket * SLOTS + kick % SLOTS
                (mark, entry), self.marks[slot], self.entries[slot] = (self.marks[slot], self.entries[slot]), mark, entry
                bucket = self._other(bucket, mark)
            return entry
        return None

    def _free(self, bucket: int, mark: int, entry) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[slot]:
                self.marks[slot], self.entries[slot] = mark, entry
                return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        kept = [e for e in self.entries if e is not None]
        while True:
            self.n *= 2
            self.resizes += 1
            self.marks, self.entries = [0] * (self.n * SLOTS), [None] * (self.n * SLOTS)
            if all(self._place(e) is None for e in kept):
                return

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot >= 0:
            self.marks[slot], self.entries[slot] = 0, None
            self.size -= 1
        return slot >= 0

    def __iter__(self):
        return (e for e in self.entries if e is not None)


_FOLDED = pa.schema([("digest", pa.binary()), ("rank", pa.int32()), ("first_id", pa.int64()), ("first_row", pa.int64()), ("live", pa.int64())])
_FOLDED_DDL = "digest binary, rank int, first_id long, first_row long, live long"


def _index(batches: Iterator[pa.RecordBatch], most: int, ordered: bool, keep: int = 1) -> Iterator[pa.RecordBatch]:
    """Folds rows of one digest into one, with the first by rank, id and row, and the sum of their counts.

    When the index holds ``most`` digests, all of them are passed on and deleted from it. Where the input is ``ordered``
    by digest, they are complete then, and those with a count under ``keep`` are not passed on.
    """
    index = CuckooIndex()

    def flush():
        rows = [(digest, *best, live) for digest, (best, live) in index if live >= keep or not ordered]
        for digest in [digest for digest, _ in index]:
            index.delete(digest)
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 50_000], strict=True), _FOLDED.types, strict=True)], schema=_FOLDED)

    for batch in batches:
        for digest, rank, i, row, live in zip(*(batch.column(c).to_pylist() for c in _FOLDED.names), strict=True):
            was = index.find(digest)
            if was is not None:
                index.replace(digest, (min(was[0], (rank, i, row)), was[1] + live))
                continue
            if index.size >= most:
                yield from flush()
            index.insert(digest, ((rank, i, row), live))
    yield from flush()


def _normal(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest) of every row; row is a number that tells repeated rows apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.encode(_normal(text_col), "UTF-8"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deleted: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``deleted`` (a table with the id column) takes documents out of the index again: they are returned with a null
    keep_id, group_size 0 and kept false, and the others as though they had never been there.
    """
    base = cut(digests(docs, id_col, text_col))
    gone = deleted.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("gone")).distinct() if deleted is not None else None
    base = base.join(gone, "id", "left") if gone is not None else base.withColumn("gone", F.lit(None).cast("boolean"))
    dead = F.coalesce("gone", F.lit(False))
    rank = F.when(dead, GONE).when(F.col("id").isNull(), NULL).otherwise(REAL)
    rows = base.select("digest", rank.alias("rank"), F.coalesce("id", F.lit(0)).alias("first_id"), F.col("row").alias("first_row"), F.lit(1).cast("long").alias("live"))
    if gone is not None:
        rows = rows.unionByName(rows.filter(F.col("rank") == GONE).withColumn("live", F.lit(-1).cast("long")))
    # a digest without a group is that of a single row; with deletions, a single live row must be told from none
    fold, span, keep = FOLD_MOST, RANGE_MOST, 2 if gone is None else 1
    folded = rows.mapInArrow(lambda batches: _index(batches, fold, False), _FOLDED_DDL)
    shards = folded.repartition(parts(docs), "digest").sortWithinPartitions("digest")
    groups = shards.mapInArrow(lambda batches: _index(batches, span, True, keep), _FOLDED_DDL)
    alone = F.col("live").isNull()
    first = F.when(F.col("rank") == REAL, F.col("first_id"))
    return base.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(dead, None).when(alone, F.col("id")).otherwise(first).alias("keep_id"),
        F.when(dead, F.lit(0)).otherwise(F.coalesce("live", F.lit(1))).cast("long").alias("group_size"),
        (~dead & (alone | (F.col("row") == F.col("first_row")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    found = exact_dedup(docs, id_col, text_col)
    return keep_rows(docs, found.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept"), id_col, F.sha2(F.encode(_normal(text_col), "UTF-8"), 256))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 AS kept, s AS text_sha256
FROM d
"""
