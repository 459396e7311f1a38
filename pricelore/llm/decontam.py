"""Benchmark items in training texts, found with a generalised suffix automaton of the items' words.

The automaton accepts every run of words of every item. A text's words are streamed through it, and at each word the
length of the longest run that ends there and stands in some item is known. Runs of a window's length or more are hits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, stored, texts_of

WINDOW = 10
#: Item words in one automaton, some 100 MB. More items make more automata, which are used one after another.
BLOCK_WORDS = 200_000
#: Automata that are broadcast for one pass over the documents, and bytes of texts that a task holds while it goes through them.
BLOCKS_AT_ONCE, HELD_BYTES = 8, 32_000_000

#: A-Z to lower case; digits, letters and what is not ASCII stay; all else separates words.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text, as UTF-8."""
    return text.encode().translate(FOLD).split()


class ItemAutomaton:
    """Suffix automaton over the words of many items."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        self._ends: list[set[int]] = [set()]
        brief: dict[int, list[int]] = {}
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            if not words:
                continue
            k, at = len(self.names), 0
            self.names.append(name)
            for w in words:
                at = self._step(at, w)
                self._ends[at].add(k)
            if len(words) < window:
                brief[k] = words
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            if self.length[self.link[v]] >= window:
                self._ends[self.link[v]] |= self._ends[v]
        none: frozenset[int] = frozenset()
        #: For each state, the items that hold the last `window` words of its runs.
        self.full = [none] * len(self.link)
        for v in order:
            up = self.link[v]
            self.full[v] = self.full[up] if self.length[up] >= window else frozenset(self._ends[v]) if self.length[v] >= window else none
        #: For each state, the brief items that its runs end with: (words, item).
        self.brief: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in brief.items():
            at = 0
            for w in words:
                at = self.next[at][w]
            own.setdefault(at, []).append((len(words), k))
        for v in order:
            self.brief[v] = (*own.get(v, ()), *self.brief[self.link[v]])
        self.least = min([window, *map(len, brief.values())])
        del self._ends

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self._ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the runs of q that are no longer than p's and w."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _step(self, last: int, w: int) -> int:
        """The state of the run that ends with w after last, made if it isn't there."""
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The spans [from, to) of hit words, in order and apart, and the items that have windows in the text."""
        n = len(words)
        if n < self.least or not self.names:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        starts, stops = known[::2], known[1::2]
        long = np.flatnonzero(stops - starts >= self.least)
        nxt, link, length, full, brief, window = self.next, self.link, self.length, self.full, self.brief, self.window
        for a, b in zip(starts[long].tolist(), stops[long].tolist()):
            v = run = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                moves = nxt[v]
                while w not in moves and v:
                    v = link[v]
                    run = length[v]
                    moves = nxt[v]
                if w in moves:
                    v = moves[w]
                    run += 1
                hit = 0
                if run >= window:
                    hit = run
                    found |= full[v]
                if brief[v]:
                    for m, k in brief[v]:
                        if m <= run:
                            found.add(k)
                            hit = max(hit, m)
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Automata over the items, a bounded number of words in each, and one item at a time on the driver."""
    held, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    for name, text in rows.toLocalIterator():
        held.append((name, text))
        words += len(words_of(text))
        if words >= block_words:
            yield ItemAutomaton(held, window)
            held, words = [], 0
    if held:
        yield ItemAutomaton(held, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns with n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words, [from, to) each)
    and clean: the text without its spans, null where nothing is hit.

    A null or empty text has no words; an item without words has no windows, one of fewer words than a window is one as a whole.
    Items of the same id count once. Rows stand for themselves, repeated ones too; of other columns only the kept ones are looked at.
    With no items nothing is hit, and no documents give no rows. BLOCKS_AT_ONCE automata are broadcast at a time; for more, what has
    been found so far is stored and goes through the table again.
    """
    spark = docs.sparkSession
    kept = texts_of(docs, text_col, *keep)
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    span = T.ArrayType(T.ArrayType(T.IntegerType(), False), False)
    before = [T.StructField("__text", T.StringType()), T.StructField("__spans", span), T.StructField("__names", T.ArrayType(T.StringType()))]
    after = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("spans", span), ("clean", T.StringType()))]
    rows = kept.select(*[F.col(f"`{f.name}`") for f in fields], "__text", F.array().cast("array<array<int>>").alias("__spans"), F.array().cast("array<string>").alias("__names"))

    def passed(rows: DataFrame, blocks: list, last: bool) -> DataFrame:
        shared = [spark.sparkContext.broadcast(pickle.dumps(a, protocol=5)) for a in blocks]
        schema = T.StructType([*fields, *(after if last else before)])
        arrow = to_arrow_schema(schema)

        def finished(own: list, texts: list[str], spans: list, names: list) -> pa.RecordBatch:
            if not last:
                return batch_of(arrow, [*own, texts, spans, [sorted(n) for n in names]])
            hits = [sum(z - a for a, z in s) for s in spans]
            shas = [hashlib.sha256(",".join(sorted(n)).encode()).hexdigest() for n in names]
            return batch_of(arrow, [*own, [len(words_of(t)) for t in texts], hits, [len(n) for n in names], shas, [h > 0 for h in hits], spans, [remove_spans(t, s) if s else None for t, s in zip(texts, spans)]])

        def run(batches):
            only = pickle.loads(shared[0].value) if len(shared) == 1 else None
            for held in _gathered(batches, 0 if len(shared) < 2 else HELD_BYTES):
                texts = [held[k].column(len(fields)).to_pylist() for k in range(len(held))]
                words = [[words_of(t) for t in ts] for ts in texts]
                spans = [[[tuple(s) for s in x] for x in b.column(len(fields) + 1).to_pylist()] for b in held]
                names = [[set(x) for x in b.column(len(fields) + 2).to_pylist()] for b in held]
                for block in shared:  # one automaton in memory at a time
                    automaton = only or pickle.loads(block.value)
                    for k, ws in enumerate(words):
                        for i, w in enumerate(ws):
                            more, items = automaton.match(w)
                            if more:
                                spans[k][i] = _merged(spans[k][i] + more)
                                names[k][i].update(automaton.names[j] for j in items)
                for k, b in enumerate(held):
                    yield finished([b.column(i).cast(arrow.field(i).type) for i in range(len(fields))], texts[k], spans[k], names[k])

        return rows.mapInArrow(run, schema)

    todo = _blocks(benchmark, item_col, item_text_col, window, block_words)
    blocks = list(islice(todo, BLOCKS_AT_ONCE))
    while len(more := list(islice(todo, BLOCKS_AT_ONCE))):
        rows = stored(passed(rows, blocks, False), "contamination")
        blocks = more
    return passed(rows, blocks, True)


def _gathered(batches, least_bytes: int):
    """Lists of batches that hold so many bytes of texts together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def remove_spans(text: str, spans: list) -> str:
    """The text without the hit words and what stands between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    out.append(text[at:])
    return "".join(out)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, coverage_limit: float = 0.5, length_col: str | None = None, **options) -> DataFrame:
    """docs without the spans that stand in benchmark items, and without the rows of whose words coverage_limit or
    more are hit. Rows without hits stay as they are, null and empty texts too. length_col, if given, is set to the
    code points of a changed text.
    """
    columns = docs.columns
    found = contamination(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__whole"), F.col(f"`{text_col}`").alias("__body")), benchmark, ("__whole",), "__body", window=window, **options)
    kept = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(coverage_limit) * F.col("n_words")))
    whole = {c: F.col("__whole").getField(c) for c in columns}
    changed = {text_col: F.when(F.col("contaminated"), F.col("clean")).otherwise(whole[text_col])}
    if length_col:
        changed[length_col] = F.when(F.col("contaminated"), F.length("clean").cast(docs.schema[length_col].dataType)).otherwise(whole[length_col])
    return kept.select(*[changed.get(c, whole[c]).alias(c) for c in columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') END AS w FROM documents),
b AS (SELECT item_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') END AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM g),
dk AS (SELECT doc_id, w, k FROM d, ks WHERE len(w) >= k),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dk),
m AS (SELECT doc_id, i, g.k AS k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM di) x JOIN g ON x.k = g.k AND x.g = g.g),
hw AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m),
h AS (SELECT doc_id, count(*) AS n FROM hw GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
 coalesce(it.sha, sha256('')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
