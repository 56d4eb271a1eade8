"""Benchmark decontamination by canonical templates.

Words are compared without case and outer punctuation; numbers, units and names become the placeholders <num>, <unit> and
<name>. Windows of WINDOW template words of the benchmark are hash-joined with all windows of all documents. Hits are laid along
the items: an item is found in a document when its hits cover at least SHARE of the item's words and the slots are filled
consistently, that is, one value of a slot in the item always has one value in the document. So a question asked again with
other numbers or names is found as well; ``exact`` tells whether the slots are unchanged but for case and outer punctuation.

A capital may mean a name or a sentence's start, so windows are compared in several forms, and one equal form is enough:

* by literals: a capital word is literal if the whole benchmark has it as a literal one. Item words get this form by the document's
  rule and, in addition, by their place in the sentence;
* by names: every capital word is <name> on both sides, but words that the item has at a sentence's start must be the same;
* plain: lower-cased words without placeholders. Exact passages are always found so, whatever they consist of.

The benchmark goes to the tasks in blocks of BLOCK_WORDS words, each with the literal words of the whole benchmark, so the cut decides
nothing. There is one scan of the documents for each block. Nothing of the documents is shuffled but the found pairs.

Edge cases: null or blank texts on either side match nothing. Items below WINDOW words are matched as one window of their own
length, of at least three words. Items of one or two words are never found. Items with fewer than half literal words in every window are
found as they are, not with other slots. Repeated rows give a pair each once per (doc_id, item_id). Null ids are kept as null. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.common import Words, bytes_of, hashed, pieces, runs, starts_in
from faultline.session import ship_package

WINDOW = 8
SHARE = 0.5
#: A window with placeholders shows something only if at least this share of its words is literal.
LITERAL = 0.5
BLOCK_WORDS = 1_000_000
UNITS = frozenset(
    b"mm cm m km inch inches feet foot ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre "
    b"litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur "
    b"percent degree degrees celsius fahrenheit kelvin km/h mph m/s watt watts volt volts".split()
)
SLOTS = frozenset((b"<num>", b"<unit>", b"<name>"))
_EDGE = regex.compile(r"^[^\p{L}\p{N}$€£%+-]+|[^\p{L}\p{N}%€$£]+$")
_NUMBER = regex.compile(r"[+\-$€£]*\p{N}[\p{N}.,:/]*(?:st|nd|rd|th)?[%$€£]?")
_END = (b".", b"!", b"?", b":", b'."', b'!"', b'?"')


def forms(word: bytes, literals: frozenset[bytes]) -> tuple[bytes, bytes, bytes]:
    """One word by literals, by names and plain, from the word alone."""
    bare = _EDGE.sub("", word.decode("utf-8", "replace"))
    if not bare:
        return word, word, word
    low = bare.lower().encode()
    if _NUMBER.fullmatch(bare):
        return b"<num>", b"<num>", low
    if low in UNITS:
        return b"<unit>", b"<unit>", low
    if bare[0].isupper():
        return low if low in literals else b"<name>", b"<name>", low
    return low, low, low


def _opens(words: list[bytes]) -> list[bool]:
    return [i == 0 or words[i - 1].endswith(_END) for i in range(len(words))]


class Terms:
    """Which words the whole benchmark has as names and as literal ones. A word that opens a sentence is a name if it is one elsewhere
    and never an ordinary word."""

    def __init__(self, texts: Iterable[str]):
        plain, capital, first = set(), set(), set()
        for text in texts:
            words = text.encode().split()
            for word, opens in zip(words, _opens(words)):
                _, name, low = forms(word, frozenset())
                if name == b"<name>":
                    (first if opens else capital).add(low)
                elif name not in SLOTS:
                    plain.add(low)
        self.names = frozenset(capital - plain)
        self.literals = frozenset(plain | (first - self.names))


class Block:
    """Items with tables of their windows in every form."""

    def __init__(self, items: list[tuple[object, str]], terms: Terms):
        self.literals = terms.literals
        self.ids, self.plain, self.templates, self.slots, self.opening = [], [], [], [], []
        found: defaultdict[tuple[int, int], set[tuple[int, int, int]]] = defaultdict(set)  # (form, width): (hash, item, offset)
        for item, text in items:
            words = text.encode().split()
            if len(words) < 3:
                continue
            literal, name, plain = (list(form) for form in zip(*(forms(w, terms.literals) for w in words)))
            template = [low if n == b"<name>" and opens and low not in terms.names else n for n, low, opens in zip(name, plain, _opens(words))]
            width = min(WINDOW, len(words))
            sure = np.ones(len(words), bool)
            steady = np.array([t not in SLOTS for t in template])
            for form, row, shows in ((0, literal, np.array([t not in SLOTS for t in literal])), (0, template, steady), (1, name, steady), (2, plain, sure)):
                enough = np.convolve(shows, np.ones(width), "valid") >= LITERAL * width
                h = runs(hashed(row), width)
                found[form, width].update((int(h[k]), len(self.ids), int(k)) for k in np.flatnonzero(enough))
            self.ids.append(item)
            self.plain.append(plain)
            self.templates.append(template)
            self.slots.append([i for i, t in enumerate(template) if t in SLOTS])
            self.opening.append([i for i, (t, n) in enumerate(zip(template, name)) if t != n])
        self.tables = {}
        for at, rows in found.items():
            if rows:
                ordered = sorted(rows)
                keys = np.array([r[0] for r in ordered], np.uint64)
                self.tables[at] = keys, np.array([r[1] for r in ordered]), np.array([r[2] for r in ordered])


def _hits(block: Block, words: Words, vocabulary: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, offset in the item, position in the document, width) of every equal window."""
    rows = [hashed(list(form))[words.codes] for form in zip(*vocabulary)] or [np.empty(0, np.uint64)] * 3
    owner = words.owner
    for (form, width), (keys, items, offsets) in block.tables.items():
        h = runs(rows[form], width)
        first = np.searchsorted(keys, h)
        hit = np.flatnonzero((keys[np.minimum(first, len(keys) - 1)] == h) & starts_in(words, width)[: len(h)])
        last = np.searchsorted(keys, h[hit], side="right")
        for position, low, high in zip(hit.tolist(), first[hit].tolist(), last.tolist()):
            for row in range(low, high):
                item, offset = int(items[row]), int(offsets[row])
                if form == 1 and any(vocabulary[words.codes[position + k - offset]][2] != block.plain[item][k] for k in block.opening[item] if offset <= k < offset + width):
                    continue
                yield int(owner[position]), item, offset, position, width


def _judged(block: Block, words: Words) -> Iterator[tuple[int, int, float, bool]]:
    """(document, item, share covered, exact) of found items."""
    grouped: defaultdict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    vocabulary = [forms(w, block.literals) for w in words.vocabulary]
    for document, item, offset, position, width in _hits(block, words, vocabulary):
        grouped[document, item].append((offset, position, width))
    for (document, item), hits in grouped.items():
        size = len(block.templates[item])
        covered = np.zeros(size, bool)
        for offset, _, width in hits:
            covered[offset : offset + width] = True
        if covered.mean() < SHARE:
            continue
        # Repeats of the passage in one document fill the slots each on its own: along one diagonal.
        diagonals: defaultdict[int, set[int]] = defaultdict(set)
        for offset, position, width in hits:
            diagonals[position - offset].update(range(offset, offset + width))
        best_exact, consistent = False, not block.slots[item]
        for start, places in diagonals.items():
            values: dict[bytes, bytes] = {}
            same = steady = True
            for slot in block.slots[item]:
                if slot in places:
                    mine, theirs = block.plain[item][slot], vocabulary[words.codes[start + slot]][2]
                    steady &= values.setdefault(mine, theirs) == theirs
                    same &= mine == theirs
            consistent |= steady
            best_exact |= steady and same and len(places) == size
        if consistent:
            yield document, item, float(covered.mean()), best_exact


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, exact): every benchmark item found in a document."""
    ship_package(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("exact", T.BooleanType())])

    def scan(sent) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in pieces(batches, text):
                rows = list(_judged(block, Words(bytes_of(batch.column(text)))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([block.ids[r[1]] for r in rows], id_type),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.bool_()),
                    ],
                    names=schema.names,
                )

        return docs.select("doc_id", text).mapInArrow(find, schema)

    id_type = to_arrow_type(benchmark.schema[item].dataType)
    asked = benchmark.where(F.col(item_text).isNotNull()).select(item, item_text)
    terms = Terms(r[1] for r in asked.toLocalIterator())
    items = (tuple(r) for r in asked.toLocalIterator())
    found, block, size = [], [], 0
    for one in items:
        block.append(one)
        size += len(one[1].split())
        if size >= BLOCK_WORDS:
            found.append(scan(context.broadcast(Block(block, terms))))
            block, size = [], 0
    if block or not found:
        found.append(scan(context.broadcast(Block(block, terms))))
    total = found[0]
    for more in islice(found, 1, None):
        total = total.unionByName(more)
    return total.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"))
