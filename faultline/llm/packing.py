"""Cost-balanced packing of documents into training sequences.

A sequence costs its tokens once (linear layers) and, for each piece of a document in it, the square of the piece's length
(attention stays inside a document). Documents are tokenized where they are read and packed in shards of a fixed number of
tokens, so no text and no id moves between machines. Inside a shard the longest document goes first, each to the sequence that costs
least so far and still has room for all of it; where none has, it is cut: the cheapest sequence with any room takes what fits.

The sequences of a shard have room for exactly its tokens: all are full but for at most log2(capacity) ones, whose lengths are the powers of
two that the rest of the shard adds up to. Nothing is padded, and every id lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.common import Words, bytes_of, pieces
from faultline.session import ship_package

CAPACITY = 4096
END = 2
#: Model width of the cost: attention costs n * n / (6 * width) where the linear layers cost n.
MODEL_WIDTH = 2048
#: Tokens that are packed together.
SHARD_TOKENS = 4_000_000
TEXT_BYTES = 2_000_000
VOCABULARY = "word_bpe_49k.json"
#: Words and parts of words whose ids a worker keeps; when it is full it starts anew, which changes the speed alone.
KEPT_WORDS = 800_000


#: Settings of a vocabulary file under which a text's ids are those of its words: nothing joins across white space, which is dropped.
WORDWISE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters that the normalizer changes only in case, then anything that the pattern above takes as one piece.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\\[-`{-~]*)")


class WordIds:
    """Token ids of texts. Where the vocabulary file works word by word (``WORDWISE``), a word is encoded once and its ids are kept, and
    words of plain letters go to the vocabulary's merges directly; any other file gets whole texts."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or public_tokenizers.path(VOCABULARY)
        self.encoder = Tokenizer.from_file(path)
        settings = json.loads(self.encoder.to_str())
        self.wordwise = settings["normalizer"] == {"type": "Sequence", "normalizers": WORDWISE["normalizer"]} and settings["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": WORDWISE["pre_tokenizer"]}
        self.wordwise &= not any(re.search(r"\s", t["content"]) or PLAIN.fullmatch(t["content"]) for t in settings["added_tokens"])
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.kept: dict[bytes | str, bytes] = {}

    def _plain(self, part: str) -> bytes:
        """Ids of letters or of marks alone."""
        found = self.kept.get(part)
        if found is None:
            ids = [t.id for t in self.encoder.model.tokenize(part.translate(self.bytes))] if part else []
            found = self.kept[part] = np.array(ids, "<u4").tobytes()
        return found

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        found = [self.kept.get(w) for w in words]
        other = []
        for i, word in enumerate(words):
            if found[i] is None:
                text = word.decode()
                plain = PLAIN.fullmatch(text)
                if plain:
                    found[i] = self.kept[word] = self._plain(plain[1].lower()) + self._plain(plain[2])
                else:
                    other.append((i, text))
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for (i, text), e in zip(part, self.encoder.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                found[i] = self.kept[words[i]] = np.array(e.ids, "<u4").tobytes()
        return found

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if not self.wordwise:
            return [np.array([*e.ids, END], "<u4") for e in self.encoder.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)]
        words = Words(texts)
        ids = self._encoded(words.vocabulary)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = lengths[words.codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        first = (np.cumsum(lengths) - lengths)[words.codes]
        taken = flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        edges = ends[words.bounds]
        return [np.append(taken[a:b], np.uint32(END)).astype("<u4") for a, b in zip(edges, edges[1:])]


_readers: dict[str | None, WordIds] = {}


def room(tokens: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly ``tokens``: full ones, then falling powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, weight: float) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the lengths of the sequences. ``weight``: cost of a squared token.

    Lengths are taken in falling order, so a sequence without room for the present one waits, by its room, until shorter ones come."""
    sizes: list[int] = []
    placed: list[tuple[int, int, int, int, int]] = []
    todo = []
    for doc, length in enumerate(lengths):
        whole = length // capacity * capacity
        for start in range(0, whole, capacity):  # these would fill the cheapest sequences there are: empty ones
            placed.append((doc, start, capacity, len(sizes), 0))
            sizes.append(capacity)
        if length > whole:
            todo.append((whole - length, doc, whole))
    heapq.heapify(todo)
    first = len(sizes)
    sizes += room(-sum(t[0] for t in todo), capacity)
    left = [0] * first + sizes[first:]
    cost = [0.0] * len(sizes)
    cheapest: list[tuple[float, int]] = []
    waiting = [(-left[s], s) for s in range(first, len(sizes))]
    heapq.heapify(waiting)
    while todo:
        need, doc, start = heapq.heappop(todo)
        length = -need
        while waiting and -waiting[0][0] >= length:
            _, s = heapq.heappop(waiting)
            heapq.heappush(cheapest, (cost[s], s))
        while cheapest and left[cheapest[0][1]] < length:
            _, s = heapq.heappop(cheapest)
            heapq.heappush(waiting, (-left[s], s))
        if cheapest:
            _, s = heapq.heappop(cheapest)
            put = length
        else:
            _, s = min((cost[s], s) for _, s in waiting)
            waiting.remove((-left[s], s))
            heapq.heapify(waiting)
            put = left[s]
            heapq.heappush(todo, (put - length, doc, start + put))
        placed.append((doc, start, put, s, sizes[s] - left[s]))
        left[s] -= put
        cost[s] += put + weight * put * put
        if left[s]:
            heapq.heappush(cheapest, (cost[s], s))
    return placed, sizes


def _batches(ids: list[np.ndarray], keys: list[pa.Array], base: int, capacity: int, weight: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    placed, sizes = assign([len(i) for i in ids], capacity, weight)
    keys = pa.concat_arrays(keys)
    for at in range(0, len(placed), 2_000):
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*placed[at : at + 2_000]))
        tokens = np.array([len(ids[d]) for d in doc], np.int64)
        body = pa.array([ids[d][a : a + n].tobytes() for d, a, n in zip(doc, start, length)], pa.binary())
        columns = [keys.take(pa.array(doc)), start, length, body, tokens, base + sequence, offset, np.array(sizes, np.int64)[sequence]]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, width: int = MODEL_WIDTH, tokenizer: str | None = None, shard: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: ``key``, start (ids of its document before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (in the sequence, gapless from 0) and sequence_tokens, the length of its sequence.

    ``tokenizer`` is the path of the vocabulary file, by default the installed one; ``capacity`` a power of two. A null or blank text is the end id alone.
    Very long texts are cut like others; a text without white space is one word to the encoder. Ties go by order of reading; repeated
    rows and null keys are packed as rows of their own. An empty table has no pieces. Other columns are not read, so their names cannot clash.
    A sequence_id is made of the number of the partition that read its documents and a count there; a task that is run again writes the same."""
    if capacity & (capacity - 1):
        raise ValueError(f"capacity {capacity} is no power of two")
    if key == "text":
        raise ValueError("the key needs another name than text")
    ship_package(docs.sparkSession)
    weight = 1 / (6 * width)
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length")], T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "sequence_tokens")]
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        reader = _readers.get(tokenizer)
        if reader is None:
            reader = _readers[tokenizer] = WordIds(tokenizer)
        base = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = 0
        for piece in pieces(batches, "text", TEXT_BYTES):
            found = reader.of(bytes_of(piece.column("text")))
            ids += found
            keys.append(piece.column(key).cast(arrow.field(0).type))
            held += sum(map(len, found))
            if held >= shard:
                yield from _batches(ids, keys, base, capacity, weight, arrow)
                base += held // capacity + capacity.bit_length()
                ids, keys, held = [], [], 0
        if ids:
            yield from _batches(ids, keys, base, capacity, weight, arrow)

    return docs.select(key, docs[text].cast("string").alias("text")).mapInArrow(packed, schema)
