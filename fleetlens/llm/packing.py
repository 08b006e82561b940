"""Packing of tokenised documents into sequences by first-fit decreasing.

A document longer than a sequence fills whole sequences of its own first; what
is left of it is one piece, shorter than a sequence.  Pieces are dealt to groups
by a hash, and each group is packed on its own: longest first, each into the
first sequence that still has room.  That sequence is found by walking down a
tournament tree, whose leaves are the rooms left and whose inner nodes hold the
larger of two.  Groups have a few thousand pieces at any size of the table.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import read, small_batches, text_of, write_and_read

CAPACITY = 1024
#: Mean number of pieces a group.
GROUP = 4096
#: The id put after each document.
END = 0
SEED = 12
#: Name of the vocabulary file, and of the same vocabulary as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Ranks are used for letters on whose classes all versions of Unicode agree, and never for very long runs,
#: which they split in time growing with the square of the run.
_SPECIAL = re.compile(r"[^\x00-ɏ]|\S{400}|\s{400}")


@functools.cache
def _encoders(vocabulary: str, ranks: str | None):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    if not ranks:
        return whole, None
    with open(public_tokenizers.path(ranks), "rb") as lines:
        known = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
    special = {token.content: at for at, token in whole.get_added_tokens_decoder().items() if token.special}
    return whole, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)


def encode(text: str, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> np.ndarray:
    """Ids of a whole text.  The ranks give the same ids in less time; what they might split otherwise is left to the vocabulary."""
    whole, fast = _encoders(vocabulary, ranks)
    if fast is None or _SPECIAL.search(text):
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), "<u4")


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For each length (longest first) its sequence and offset there, and how full each sequence is."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    sequence, offset = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        sequence.append(node - leaves)
        offset.append(capacity - room[node])
        room[node] -= length
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
    return sequence, offset, [capacity - x for x in room[leaves:leaves + len(set(sequence))]]


def padded(fill: int, capacity: int) -> int:
    """Length after padding: a power of two stays as it is."""
    return fill if fill & (fill - 1) == 0 else capacity


def pieces(docs: DataFrame, capacity: int, vocabulary: str, ranks: str | None, with_ids: bool) -> DataFrame:
    """Each document's ids cut at multiples of the capacity."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                all_ids = np.append(encode(text, vocabulary, ranks), np.array([END], "<u4"))
                for at in range(0, len(all_ids), capacity):
                    piece = all_ids[at:at + capacity]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(all_ids))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            yield pa.RecordBatch.from_arrays(
                out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else []))

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = SEED, vocabulary: str = VOCABULARY,
         ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to and, if asked, ids.

    A missing text is an empty one, and an empty text is the closing id alone.
    Rows without doc_id, with the same one, or repeated whole are packed each for
    itself.  Equal lengths are packed in the order of the pieces' numbers, which
    are written down before they are used.  Sequences are numbered without order
    or regard to gaps: those of a group by group and place, those that one piece
    fills by the piece's number.  ``padded_to`` is the sequence's length after
    padding.  An empty table gives no rows; other columns are not read.
    """
    cut = write_and_read(pieces(docs, capacity, vocabulary, ranks, with_ids)
                         .withColumn("piece", F.monotonically_increasing_id()))
    parts = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-parts.count() // group))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("piece", "ascending")])
        sequence, offset, fill = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        first = table.column("group")[0].as_py() << 31 if table.num_rows else 0
        added = {"sequence_id": [2 * (first + s) for s in sequence], "offset": offset, "padded_to": [padded(fill[s], capacity) for s in sequence]}
        table = table.drop_columns(["group", "piece"])
        for name, values in added.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "piece"]
    packed = (parts.withColumn("group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)))
              .groupBy("group").applyInArrow(fit, ", ".join([*columns, "sequence_id long", "offset long", "padded_to long"])))
    full = cut.filter(F.col("length") == capacity).withColumns({
        "sequence_id": 2 * F.col("piece") + 1, "offset": F.lit(0).cast("bigint"), "padded_to": F.lit(capacity).cast("bigint")})
    return packed.unionByName(full.drop("piece"))


def op12_tournament_packing(spark, sf: str) -> DataFrame:
    return pack(read(spark, sf, "documents"))
