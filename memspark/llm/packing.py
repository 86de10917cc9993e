"""Packing of token sequences under several limits at once: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm import vocab
from memspark.llm.codec import codec
from memspark.llm.rows import light, tidy, whole

#: Bytes of text that are encoded at once; a longer text is by itself.
SLICE_BYTES = 2_000_000
#: Bits of a sequence's number inside its task; above them stands the task's number.
TASK_SHIFT = 40


class Packer:
    """Fills sequences from a pool of examples; each open sequence takes the example that points most its way.

    Demands and what is left are vectors (tokens, segments, loss-bearing tokens) in shares of the limits. Of the examples
    that fit, the one with the largest dot product of demand and rest goes in; the sequence closes when none fits. With
    ``cut``, the example with the largest product is then cut to fill the rest, and a sequence that still isn't full at
    its close is dealt into sequences whose lengths are powers of two, which need no padding.

    An example is [number, start, tokens, silent]: its first ``silent`` tokens bear no loss.
    """

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, pool: int = 512):
        self.limit = np.array([tokens, segments, loss], dtype=np.int64)
        self.cut, self.pool = cut, pool
        self.number = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int64)
        self.silent = np.zeros(0, np.int64)
        self.sequences = 0

    def add(self, number: int, tokens: int, silent: int = 0) -> None:
        for name, value in (("number", number), ("start", 0), ("tokens", tokens), ("silent", silent)):
            setattr(self, name, np.append(getattr(self, name), value))

    def extend(self, number: np.ndarray, tokens: np.ndarray, silent: np.ndarray) -> None:
        for name, value in (("number", number), ("start", np.zeros_like(tokens)), ("tokens", tokens), ("silent", silent)):
            setattr(self, name, np.concatenate([getattr(self, name), value]))

    def __len__(self) -> int:
        return len(self.number)

    def _drop(self, i: int) -> None:
        """The last example takes the place of example i."""
        for name in ("number", "start", "tokens", "silent"):
            a = getattr(self, name)
            a[i] = a[-1]
            setattr(self, name, a[:-1])

    def fill(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """One sequence, as pieces (number, start, length, sequence, offset, padded length)."""
        left, pieces, used = self.limit.copy(), [], 0
        while len(self) and left[0] > 0 and left[1] > 0:
            loss = np.maximum(self.tokens - self.silent, 0)
            rest = left / np.maximum(self.limit, 1)
            scale = rest / np.maximum(self.limit, 1)
            product = self.tokens * scale[0] + scale[1] + loss * scale[2]
            fits = (self.tokens <= left[0]) & (loss <= left[2])
            if fits.any():
                i = int(np.argmax(np.where(fits, product, -1.0)))
                take = int(self.tokens[i])
            elif self.cut:
                i = int(np.argmax(product))
                take = int(min(left[0], self.silent[i] + left[2], self.tokens[i]))
                if take <= 0:
                    break
            elif not pieces:  # over a limit by itself: it stays whole and alone
                i = int(np.argmax(product))
                take = int(self.tokens[i])
            else:
                break
            bears = max(0, take - int(self.silent[i]))
            pieces.append((int(self.number[i]), int(self.start[i]), take))
            used += take
            left -= np.array([take, 1, bears])
            if take == self.tokens[i]:
                self._drop(i)
            else:
                self.start[i] += take
                self.tokens[i] -= take
                self.silent[i] = max(0, int(self.silent[i]) - take)
        yield from self._lay(pieces, used)

    def _lay(self, pieces: list[tuple[int, int, int]], used: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        full = int(self.limit[0])
        # Bits of the length from the highest: the lengths of the sequences that need no padding.
        powers = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1] if self.cut and used < full else [used]
        room = at = 0
        for number, start, length in pieces:
            while length or not room and not length and at == 0 and used == 0:
                if not room:
                    room, at, size = powers[0], 0, powers.pop(0)
                    self.sequences += 1
                n = min(length, room)
                yield number, start, n, self.sequences - 1, at, size if size >= full or size & (size - 1) == 0 else full
                start, length, room, at = start + n, length - n, room - n, at + n
                if used == 0:
                    break


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 4096,
    end_id: int = 2,
    segments: int = 4096,
    loss_tokens: int | None = None,
    silent: str | None = None,
    cut: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """Whole documents as pieces of sequences: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    A document is its identifiers and ``end_id``. A sequence has at most ``capacity`` tokens, ``segments`` pieces and
    ``loss_tokens`` tokens (default: ``capacity``) that bear loss; the first ``silent`` tokens (a column) of a document
    bear none, such as an instruction before its answer. Without ``cut``, documents stay whole, and one beyond a limit
    gets a sequence of its own. ``padded`` is the length to pad to; ``with_ids`` adds the identifiers.

    Each task fills sequences from its own rows, so nothing is shuffled, and at most one pool of documents is held. A
    sequence's number has the task's number in its upper bits, and is the same if a lost task runs again. With ``cut``
    and segments to spare, no sequence needs padding, whatever the number of tasks.

    A null or empty text is one piece with ``end_id`` alone. Null keys and repeated rows are documents of their own, a
    null ``silent`` is 0. An empty table gives an empty one.
    """
    file, most = vocab.path(tokenizer), capacity if loss_tokens is None else loss_tokens
    if min(capacity, segments, most) < 1:
        raise ValueError("limits must be positive")
    names = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long" + ", ids array<int>" * with_ids
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(names).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << TASK_SHIFT
        packer = Packer(capacity, segments, most, cut)
        keys, ids, count = {}, {}, 0
        key_type = None
        codec(file)
        vocab.forget()

        def pieces(rest: int) -> Iterator[pa.RecordBatch]:
            out = []
            while len(packer) > rest:
                out += packer.fill()
            if not out:
                return
            number, start, length, sequence, offset, padded = map(list, zip(*out, strict=True))
            tokens = [ids[n][4 * s : 4 * (s + c)] for n, s, c in zip(number, start, length, strict=True)]
            columns = [
                pa.array([keys[n] for n in number], key_type), *(pa.array(x, pa.int64()) for x in (start, length)),
                pa.array(map(zlib.crc32, tokens), pa.int64()), pa.array([len(ids[n]) // 4 for n in number], pa.int64()),
                *(pa.array(x, pa.int64()) for x in ([base + s for s in sequence], offset, padded)),
                *([pa.array([np.frombuffer(t, "<i4") for t in tokens], pa.list_(pa.int32()))] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            waiting = set(packer.number.tolist())
            for n in set(number) - waiting:
                del keys[n], ids[n]

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            key_type = batch.column(0).type
            done = 0
            for part in vocab.slices(batch.column(1), SLICE_BYTES):
                own = batch.column(0).slice(done, len(part)).to_pylist()
                quiet = batch.column(2).slice(done, len(part)).to_numpy(zero_copy_only=False)
                done += len(part)
                made = [bytes(b) + end for b in codec(file).encoded(part)]
                # Not the whole part at once, so that the pool stays near its size.
                for i in range(0, len(made), packer.pool):
                    some = range(i, min(len(made), i + packer.pool))
                    numbers = np.arange(count, count + len(some))
                    count += len(some)
                    keys.update(zip(numbers.tolist(), (own[j] for j in some), strict=True))
                    ids.update(zip(numbers.tolist(), (made[j] for j in some), strict=True))
                    packer.extend(numbers, np.array([len(made[j]) // 4 for j in some]), quiet[i : i + len(some)])
                    yield from pieces(packer.pool)
                made = some = numbers = None
        yield from pieces(0)
        keys, ids, batch, part = {}, {}, None, None
        tidy()

    silence = F.greatest(F.coalesce(F.col(silent).cast("long"), F.lit(0)), F.lit(0)) if silent else F.lit(0).cast("long")
    return light(docs.select(F.col(key), whole(text).alias(text), silence.alias("__silent"))).mapInArrow(run, schema)
