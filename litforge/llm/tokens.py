"""Problem 8: encode a corpus with a public byte-level BPE tokenizer.

Merging uses a segment tree over byte positions. Leaf i holds the rank of the pair that starts at live
position i, inner nodes the least ``rank * size + position`` below them, so the root is the leftmost of the
lowest-ranked pairs. A merge changes the leaves of the merged pair, of its right half and of its live left
neighbour: three point updates of logarithmic cost. A piece of n bytes therefore costs O(n log n) however
long it is (scripts without spaces give pieces of many hundred bytes).

Defined results: null and empty text give an empty list; text that spells a special token is ordinary text;
repeated texts give equal lists; extra columns are kept by ``encode`` as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public tokenizers; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k.json"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by one Python worker; the memo is emptied when full, results don't depend on it.
MEMO = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies, made from the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte], spare = chr(spare), spare + 1
    return letters


class SegmentTreeBpe:
    """Byte-pair encoder of one vocabulary file."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab = model["vocab"]
        self.bytes = [vocab[x] for x in byte_letters()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.none = len(self.pairs)
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.bytes[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        pairs, none = self.pairs, self.none
        size = 1 << (n - 1).bit_length()
        never = none * size
        tree = [never] * (2 * size)
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                tree[size + i] = found[0] * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                best = min(tree[at], tree[at ^ 1])
                at >>= 1
                if tree[at] == best:
                    return
                tree[at] = best

        def pair_at(i: int) -> int:
            j = after[i]
            found = pairs.get((ids[i], ids[j])) if j < n else None
            return found[0] * size + i if found else never

        while (least := tree[1]) < never:
            i = least % size
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            put(j, never)
            put(i, pair_at(i))
            if before[i] >= 0:
                put(before[i], pair_at(before[i]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8"))
                if len(piece) <= 256:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, SegmentTreeBpe] = {}


def _encoder(spec) -> SegmentTreeBpe:
    """The encoder of a broadcast vocabulary, made once in each Python worker."""
    key = hash(spec.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentTreeBpe(spec.value)
    return _ENCODERS[key]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``df`` with the token ids of column ``text`` as column ``ids`` (array of int), replacing a column of that name.

    The vocabulary file (under 2 MB whatever the corpus) is read on the driver and broadcast. No shuffle.
    """
    with open(f"{folder}/{name}", encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    rest = [c for c in df.columns if c != ids]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*[f for f in df.schema.fields if f.name != ids], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(spec).encode
        for batch in batches:
            values: list[int] = []
            offsets = [0]
            for text_value in batch.column(len(rest)).to_pylist():
                values += coder(text_value)
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists], names=[*rest, ids])

    return source.mapInArrow(run, schema)


def token_count(df: DataFrame, text: str = "text", count: str = "n_tokens", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """``df`` with the number of tokens of column ``text`` (0 for null and empty text)."""
    return encode(df, text, "__ids", folder, name).withColumn(count, F.size("__ids").cast("long")).drop("__ids")


def id_sum(ids: Column) -> Column:
    """Sum of the ids, for checks that should not carry whole lists."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
