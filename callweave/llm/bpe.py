"""Byte-level BPE encoding and decoding with a global table of distinct words.

1. Texts are cut into pre-tokens. A task deals its texts to blocks of bounded size; a block
   lists its distinct pre-tokens once, and holds each text as positions in that list.
2. The lists are shuffled by the words' hash buckets, and each distinct word is encoded once.
3. The ids are joined back to the blocks, and each text is put together by position.
4. Decoding looks every id up in the table of token bytes, whose size the vocabulary bounds.

Defined cases: null and empty texts have no ids; repeated rows are encoded one by one; a
text of any length is one row and is never cut; of merges of equal rank the first in the text comes first; an empty
table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW, checkpointed, small_batches

#: A block is closed at this many distinct pre-tokens or pre-tokens.
BLOCK_WORDS, BLOCK_TOKENS = 200_000, 2_000_000
#: Hash buckets of words: one for so many partitions of the texts, from the least to the most.
PARTITIONS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 16, 1024, 65536
#: Words of a bucket that a task remembers.
KNOWN_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a rank file: one base64 token and its rank in a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, the leftmost first, until none is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        middle = ends[i]
        if middle is None or middle >= n:
            continue
        end = ends[middle]
        if ranks.get(word[i:end]) != rank:
            continue  # a part of this pair has been merged since
        ends[i], ends[middle] = end, None
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


class Splitter:
    """Cuts texts into pre-tokens, and remembers how runs between spaces are cut.

    No pre-token crosses the point before a space that is followed by a visible character,
    so such runs can be cut by themselves. Texts with other spaces are cut as a whole.
    """

    def __init__(self, pattern: str):
        self.cut = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?:\s|\Z)").search

    def __call__(self, text: str) -> list[str]:
        if self.odd(text):
            return [self.cut(text)]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]


class Block:
    """Distinct pre-tokens of some texts, and the texts as positions in that list."""

    def __init__(self, split: Splitter, name: int):
        self.split, self.name = split, name
        self.words: dict[str, int] = {}
        self.runs: dict[str, tuple[int, ...]] = {}
        self.tokens = 0

    def positions(self, text: str) -> np.ndarray:
        words, runs, out = self.words, self.runs, []
        pieces = self.split(text)
        if pieces and isinstance(pieces[0], list):
            out = [words.setdefault(w, len(words)) for w in pieces[0]]
        else:
            for run in pieces:
                known = runs.get(run)
                if known is None:
                    known = runs[run] = tuple([words.setdefault(w, len(words)) for w in self.split.cut(run)])
                out += known
        self.tokens += len(out)
        return np.array(out, "<u4")

    def full(self) -> bool:
        return len(self.words) >= BLOCK_WORDS or self.tokens >= BLOCK_TOKENS

    def check(self) -> int:
        return zlib.crc32("\0".join(self.words).encode())

    def packs(self, buckets: int) -> list[tuple[int, bytes]]:
        """The words by bucket, each with its place in the list."""
        held: dict[int, tuple[list, list]] = {}
        for at, word in enumerate(self.words):
            data = word.encode()
            ats, words = held.setdefault(zlib.crc32(data) % buckets, ([], []))
            ats.append(at)
            words.append(data)
        return [(bucket, pack(np.array(ats, "<u4"), words)) for bucket, (ats, words) in held.items()]


def pack(at: np.ndarray, held: list[bytes]) -> bytes:
    """Ascending places and what belongs to them."""
    return zlib.compress(pickle.dumps((np.diff(at, prepend=np.uint32(0)).tobytes(), held), 5), 1)


def unpack(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    steps, held = pickle.loads(zlib.decompress(data))
    return np.cumsum(np.frombuffer(steps, "<u4"), dtype="<u4"), held


def squeeze(at: np.ndarray) -> bytes:
    """Positions, low halves first: the high halves are mostly zero."""
    return zlib.compress(at.astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(data), "<u2").reshape(2, -1)
    return low | high.astype("<u4") << 16


def in_blocks(batches, pattern: str):
    """Deals texts to blocks: (block, ids and positions of texts, whether it is closed now).

    A block is named by its task's partition and its number there, so that a task which
    runs again makes the same blocks.
    """
    split, at = Splitter(pattern), TaskContext.get().partitionId() << 32
    block = Block(split, at)
    for batch in batches:
        ids, bodies = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(key)
            bodies.append(block.positions(text or ""))
            if block.full():
                yield block, ids, bodies, True
                at += 1
                block, ids, bodies = Block(split, at), [], []
        if ids:
            yield block, ids, bodies, False
    yield block, [], [], True


def word_packs(texts: DataFrame, pattern: str, n_buckets: int) -> DataFrame:
    """block, bucket, pack, check: the distinct pre-tokens of every block by hash bucket."""

    def run(batches):
        for block, _, _, closed in in_blocks(batches, pattern):
            if closed and block.words:
                buckets, packs = zip(*block.packs(n_buckets))
                n = len(packs)
                columns = [pa.array([block.name] * n, pa.int64()), pa.array(buckets, pa.int32()), pa.array(packs, pa.binary()), pa.array([block.check()] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "pack", "check"])

    return texts.mapInArrow(run, "block bigint, bucket int, pack binary, check bigint")


def text_bodies(texts: DataFrame, pattern: str, kind: str) -> DataFrame:
    """block, ids, sizes, body, check: the texts of a batch as positions in the list of their block.

    check is set in the row that closes a block.
    """
    id_type = pa.list_(ARROW[kind])

    def run(batches):
        for block, ids, bodies, closed in in_blocks(batches, pattern):
            sizes = [len(x) for x in bodies]
            body = squeeze(np.concatenate(bodies) if bodies else np.zeros(0, "<u4"))
            check = block.check() if closed and block.words else None
            columns = [pa.array([block.name], pa.int64()), pa.array([ids], id_type), pa.array([sizes], pa.list_(pa.int32())), pa.array([body], pa.binary()), pa.array([check], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "body", "check"])

    return texts.mapInArrow(run, f"block bigint, ids array<{kind}>, sizes array<int>, body binary, check bigint")


def encoded_packs(packs: DataFrame, ranks, width: str) -> DataFrame:
    """block, pack, check, with the ids of each word in the word's place.

    All packs of a bucket meet in one task, one after the other, and each of its distinct words is
    encoded once; only in a bucket of more than KNOWN_WORDS words they are forgotten on the way.
    """

    def run(batches):
        table, known, last = ranks.value, {}, None
        for batch in batches:
            made = []
            for data, bucket in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                at, words = unpack(data)
                if bucket != last or len(known) > KNOWN_WORDS:
                    known.clear()
                    last = bucket
                ids = []
                for word in words:
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(encode_word(word, table), width).tobytes()
                    ids.append(found)
                made.append(pack(at, ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["block", "pack", "check"])

    dealt = packs.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("block", "pack", "check", "bucket").mapInArrow(run, "block bigint, pack binary, check bigint")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", work=None, outputs: str = "ids binary", stable: bool = False) -> DataFrame:
    """id and the ids of every text, as unsigned 32-bit little-endian integers.

    work maps the ids of one text to a tuple for the columns named in outputs, so that a
    caller which needs less than the ids need not move them. The texts are cut twice, once
    for the words and once for the positions: this moves and stores less than keeping both. Both
    times they must come in the same order, also after executors were lost. A caller says by
    `stable` that they do, as those that are read from files and not shuffled since; other texts
    are written to the checkpoint folder first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    # An id of any type travels as it is written; it is cast back in the end.
    own = docs.schema[id_col].dataType.simpleString()
    kind = own if own in ARROW else "string"
    texts = docs.select(F.col(id_col).cast(kind), F.col(text_col).cast("string"))
    if not stable:
        texts = checkpointed(texts)
    word_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, texts.rdd.getNumPartitions() // PARTITIONS_A_BUCKET))
    width = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
    known = encoded_packs(word_packs(texts, pattern, word_buckets), shared, width)
    bodies = text_bodies(texts, pattern, kind)
    schema = pa.schema([pa.field("id", ARROW[kind])] + [pa.field(n, ARROW[t]) for n, t in (x.split() for x in outputs.split(", "))])
    work = work or (lambda ids: (ids.tobytes(),))

    def assemble(packs: pa.Table, bodies: pa.Table) -> pa.Table:
        checks = set(packs["check"].to_pylist()) | set(bodies["check"].drop_null().to_pylist())
        if len(checks) > 1:
            raise ValueError("the texts were dealt to other blocks when they were cut again")
        held: list[tuple[np.ndarray, list[bytes]]] = [unpack(x.as_py()) for x in packs["pack"]]
        places = np.concatenate([at for at, _ in held]) if held else np.zeros(0, "<u4")
        words = [w for _, part in held for w in part]
        flat = np.frombuffer(b"".join(words), width)
        lengths = np.fromiter((len(w) // flat.itemsize for w in words), np.int64, len(words))
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[places], start[places] = lengths, np.cumsum(lengths) - lengths
        keys, made = [], []
        for ids, sizes, body in zip(bodies["ids"].to_pylist(), bodies["sizes"].to_pylist(), bodies["body"]):
            at = unsqueeze(body.as_py())
            for key, part in zip(ids, np.split(at, np.cumsum(sizes)[:-1]) if ids else []):
                count = size[part]
                ends = np.cumsum(count)
                take = np.repeat(start[part] - ends + count, count) + np.arange(int(count.sum()))
                keys.append(key)
                made.append(work(flat[take].astype("<u4")))
        columns = list(zip(*made)) or [[] for _ in range(len(schema) - 1)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip([keys, *columns], schema)], schema=schema)

    made = known.groupBy("block").cogroup(bodies.groupBy("block")).applyInArrow(assemble, f"id {kind}, {outputs}")
    return made.withColumn("id", F.col("id").cast(own)).withColumnRenamed("id", id_col)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of every id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded bytes of rows of ids, by the broadcast table of token bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))
    kind = encoded.schema[id_col].dataType.simpleString()
    small_batches(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            made = [None if x is None else decode_ids(np.frombuffer(x, "<u4"), shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "decoded"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col)).mapInArrow(run, f"id {kind}, decoded binary")
    return out.withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """id, n_tokens, and the hashes of the ids and of what they decode to. stable: as in encode."""
    shared = docs.sparkSession.sparkContext.broadcast(token_table(ranks))

    def work(ids):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, shared.value)).hexdigest()

    return encode(docs, ranks, pattern, id_col, text_col, work, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", stable)
