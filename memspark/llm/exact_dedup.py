"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing texts chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.rows import attach, kept, same, whole
from memspark.session import small_enough

#: Bytes hashed on their own; a text of any length is a sequence of such chunks.
CHUNK = 1 << 16
#: (prime, base) of the two polynomials. Together with the length they make the fingerprint.
POLYNOMIALS = ((2147483647, 1103515245), (2147483629, 1664525013))
#: Members of a group that are compared with one copy of its first text.
MEMBERS_PER_COPY = 256
#: Keys of candidates that are broadcast to the second reading of the texts; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A white space run that one blank must replace; a lone blank is none.
RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: str) -> Column:
    """The text (null: empty) with each run of ASCII white space as one blank."""
    return F.regexp_replace(whole(text), RUN, " ")


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out[:n][::-1].copy()


def chunk_hash(chunk: np.ndarray, powers: list[np.ndarray]) -> list[int]:
    """The value of each polynomial for up to CHUNK bytes. A zero byte counts as 1, so that lengths always show."""
    wide = chunk.astype(np.uint64) + np.uint64(1)
    return [int(wide @ p[len(p) - len(wide) :]) % prime for (prime, _), p in zip(POLYNOMIALS, powers, strict=True)]


def shifted(hashes: list[int], after: int) -> list[int]:
    """What a chunk adds to the fingerprint of a text in which ``after`` bytes follow it.

    The fingerprint of A followed by B is hash(A) * base^|B| + hash(B); so chunks are hashed in any order and place and
    their shifted hashes added.
    """
    return [h * pow(base, after, prime) % prime for h, (prime, base) in zip(hashes, POLYNOMIALS, strict=True)]


def _chunks(binary: str, size: str) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(CHUNK))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(binary), i * CHUNK + 1, F.lit(CHUNK)))


def fingerprints(docs: DataFrame, key: str, text: str, mask: int = -1) -> DataFrame:
    """Per row: row (a number of its own), ``key``, text_sha256, n_bytes and print, the two polynomials in one long.

    Chunks are rows of their own before they are hashed: neither a batch nor the sum by row ever holds a whole huge
    document. ``mask`` keeps some bits of the fingerprint only, for tests of what happens when it lies.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), normalised(text).alias("norm"))
    flat = base.select("row", key, F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("n_bytes"), F.col("norm").cast("binary").alias("norm"))
    parts = flat.select("row", key, "text_sha256", "n_bytes", F.posexplode(_chunks("norm", "n_bytes")).alias("at", "chunk"))
    schema = parts.drop("at", "chunk").withColumns({"one": F.lit(0).cast("long"), "two": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(*p, CHUNK) for p in POLYNOMIALS]
        for batch in batches:
            size, at = batch.column("n_bytes").to_pylist(), batch.column("at").to_pylist()
            made = [
                shifted(chunk_hash(np.frombuffer(c.as_buffer(), dtype=np.uint8), powers), max(0, n - (i + 1) * CHUNK))
                for c, n, i in zip(batch.column("chunk"), size, at, strict=True)
            ]
            both = np.array(made, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both[:, 0]), pa.array(both[:, 1])], names=schema.names)

    summed = parts.mapInArrow(run, schema).groupBy("row", key, "text_sha256", "n_bytes").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    (p, _), (q, _) = POLYNOMIALS
    both = F.shiftleft(F.col("one") % p, 31).bitwiseOR(F.col("two") % q).bitwiseAND(F.lit(mask).cast("long"))
    return summed.select("row", key, "text_sha256", "n_bytes", both.alias("print"))


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """(n_bytes, print, size, first): the first row has the smallest key, null keys last, then the smallest row number."""
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("row"), F.col("text_sha256").alias("sha")))
    return rows.groupBy("n_bytes", "print").agg(F.count("*").alias("size"), first.alias("first"))


def _different(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, text_sha256, n_bytes, print) of members whose text differs from that of their group's first row.

    Member and first text meet chunk by chunk: rows of the join are chunks. A large group's first text is copied once
    for so many members, so that no task gets a whole group.
    """
    identity = [key, "text_sha256", "n_bytes", "print"]
    is_first = (F.col("row") == F.col("first.row")).cast("int")
    own = members.groupBy(*identity).agg(F.max("size").alias("size"), F.max(is_first).alias("is_first"))
    keys = own.select(key).distinct()
    few = small_enough(keys, BROADCAST_KEYS)
    texts = same(docs.select(key, F.col(text)), keys, [key], "left_semi", broadcast=few).select(key, normalised(text).alias("norm"))
    texts = texts.withColumn("text_sha256", F.sha2("norm", 256)).dropDuplicates([key, "text_sha256"])
    found = same(texts, own, [key, "text_sha256"])
    parts = found.withColumn("norm", F.col("norm").cast("binary")).select(*identity, "size", "is_first", F.posexplode(_chunks("norm", "n_bytes")).alias("at", "chunk"))
    parts = kept(parts)
    copies = F.ceil(F.col("size") / F.lit(MEMBERS_PER_COPY)).cast("int")
    firsts = parts.filter("is_first = 1").select("n_bytes", "print", "at", F.col("chunk").alias("own"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    others = parts.filter("is_first = 0").withColumn("copy", F.pmod(F.xxhash64(key, "text_sha256"), copies).cast("int"))
    met = others.join(firsts, ["n_bytes", "print", "at", "copy"])
    return met.filter(F.col("chunk") != F.col("own")).select(*identity).distinct()


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: int = -1) -> DataFrame:
    """Per row: ``key``, keep_id (``key`` of the row that stays), group_size, kept, text_sha256.

    Texts are equal if they are so after each run of ASCII white space became one blank; null counts as empty. Rows are
    grouped by length and fingerprint, then every member's text is compared with the first one's; those that differ
    are grouped anew among themselves until none do, so the result is exact whatever the fingerprints.

    Only fingerprints are shuffled for all rows; texts only where a fingerprint repeats. Of equal texts the row of the
    smallest ``key`` stays (null keys last, of repeated rows one). An empty table gives an empty one; other columns,
    whatever their names, are not looked at.
    """
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = kept(fingerprints(docs, "__key", "__text", mask))
    open_rows, settled, level = rows, None, 0
    while True:
        groups = _groups(open_rows, "__key")
        grouped = kept(attach(open_rows, groups, ["n_bytes", "print"], "size", open_rows.count()))
        repeated = grouped.filter("size > 1")
        wrong = kept(_different(docs, repeated, "__key", "__text"))
        if wrong.isEmpty():
            done, open_rows = grouped, None
        else:
            # Fingerprints that lied: settle those that agree with the first text, and go on with the others.
            identity = ["__key", "text_sha256", "n_bytes", "print"]
            right = same(open_rows, wrong, identity, "left_anti")
            done = attach(right, _groups(right, "__key"), ["n_bytes", "print"], "size", rows.count())
            open_rows = kept(same(open_rows, wrong, identity, "left_semi"))
        settled = done if settled is None else settled.unionByName(done)
        if open_rows is None:
            break
        level += 1
    return settled.select(
        F.col("__key").alias(key), F.col("first.key").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
    )
