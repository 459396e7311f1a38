"""Near duplicates by SimHash: fingerprints of 64 bits that differ in few bits are linked.

Fingerprints go into an inverted index by the values of their bytes at fixed positions. Two that differ in at most three
bits share at least five of their eight bytes, so pairs are held to that count before their bits are compared. A list for
one byte would hold a 256th of all fingerprints; the lists are therefore keyed by three positions, all within the first or
all within the last four bytes: of any five shared bytes, three lie in one half, so each such pair meets in a list.

Few bits are a strict test: texts with a Jaccard similarity of 0.8 differ in about ten of 64. Where a similarity is asked for,
sketches of minimum hashes find candidates beside the fingerprints, in the same way: rows meet in lists by bands of minima,
and pairs of a list are held to the share of equal sketch bytes, with room for its error. The shingles of the two
texts then decide each candidate exactly. A search through each list gives the first candidates; then all pairs of a list that are
not connected yet are checked by their sets where the list is, without a limit, and a list gives fewer links than it has classes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import batch_of, released, shared_folder, small, stored, texts_of

MOST_BITS = 3
SHARED_BYTES = 8 - MOST_BITS
#: Byte positions that make a list's key: 0 is the lowest byte.
KEYS = tuple(p for half in (range(4), range(4, 8)) for p in combinations(half, 3))
#: A longer list is searched through lists of more positions.
DENSE = 2048
#: Minima in a sketch, of which one byte each is kept; the error of the estimated similarity is about 0.035 at 0.8.
LANES = 128
#: Bands of four minima each: texts of similarity 0.8 share one with probability 0.9998.
BANDS, BAND_ROWS = 16, 4
#: Compressed bytes of the texts of a list whose sets are held at a time, twice; and shingles that are looked up at once.
BLOCK_BYTES = 4_000_000
LOOKED_UP = 1 << 20
_RANDOM = np.random.default_rng(64)
_ODD = _RANDOM.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, LANES, dtype=np.uint64)
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256))


def shingle_hashes(text: str, shingle_words: int = 3) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; none if it has no words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)])) if len(words) >= shingle_words else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The fingerprint of one text, unsigned; 0 if it has no words."""
    return fingerprint_of(shingle_hashes(text, shingle_words))


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each lane over a text's shingles; all ones if it has none."""
    low = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(low, (hashes[None, at : at + 256] * _ODD[:, None] + _PLUS[:, None]).min(axis=1), out=low)
    return low


def sketch_of(minima: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A byte of each minimum, and the key of each band."""
    mixed = minima * np.uint64(0x9E3779B97F4A7C15)
    bands = mixed[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        keys = (keys ^ (keys >> np.uint64(32)) ^ bands[:, i]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes(), keys


def least_equal(similarity: float) -> int:
    """Equal bytes of two sketches from which they are candidates: three standard errors below what the similarity gives. Unequal
    minima share a byte once in 256."""
    low = similarity - 3 * (similarity * (1 - similarity) / LANES) ** 0.5
    return round(LANES * (low + (1 - low) / 256))


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle_words: int = 3, sketches: bool = False) -> DataFrame:
    """The kept columns and __fp, the fingerprint as a signed long; with sketches, also __sketch, __bands, __node, a hash of the
    set of shingles, and __body, the compressed text."""
    kept = texts_of(df, text_col, *keep)
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    more = [T.StructField("__sketch", T.BinaryType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__node", T.LongType()), T.StructField("__body", T.BinaryType())] if sketches else []
    schema = T.StructType([*fields, T.StructField("__fp", T.LongType()), *more])
    arrow = to_arrow_schema(schema)

    def run(batches):
        from xxhash import xxh64_intdigest
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=3).compress
        for b in batches:
            fps, marks, bands, nodes, bodies = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                hashes = shingle_hashes(t, shingle_words)
                fps.append(fingerprint_of(hashes))
                if sketches:
                    own = np.unique(hashes)
                    mark, keys = sketch_of(minima_of(own))
                    nodes.append(xxh64_intdigest(own.tobytes()))
                    bodies.append(squeeze(t.encode()))
                    marks.append(mark)
                    bands.append(keys.view(np.int64))
            fps = np.array(fps, np.uint64).view(np.int64)
            yield batch_of(arrow, [*[b.column(i).cast(arrow.field(i).type) for i in range(len(fields))], pa.array(fps), *([marks, bands, np.array(nodes, np.uint64).view(np.int64), bodies] if sketches else [])])

    return kept.mapInArrow(run, schema)


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; a label is the place of the smallest member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _dense(fps: np.ndarray, places: np.ndarray, label: np.ndarray, most_bits: int) -> None:
    """Link the fingerprints at the given places: tally shared bytes, keep pairs with enough, compare bits."""
    own = fps[places]
    for at in range(0, len(own), 256):
        x = own[at : at + 256, None] ^ own[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(shared >= 8 - most_bits)
        near = (np.bitwise_count(x[i, j]) <= most_bits) & (i + at < j)
        _hook(label, places[i[near] + at], places[j[near]])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    return edges[:-1], edges[1:]


def _long(fps: np.ndarray, key: tuple[int, ...], label: np.ndarray, most_bits: int) -> None:
    """Link distinct fingerprints that agree at the key's positions and are too many to compare all with all."""
    free = [p for p in range(8) if p not in key]
    for more in combinations(free, max(0, 8 - most_bits - len(key))):
        mask = reduce(lambda m, p: m | 0xFF << 8 * p, more, 0)
        order = np.argsort(fps & np.uint64(mask), kind="stable")
        for a, b in zip(*_runs((fps & np.uint64(mask))[order])):
            places = order[a:b]
            if len(places) < 2:
                continue
            if len(places) <= DENSE:
                _dense(fps, places, label, most_bits)
                continue
            # At most 2**24 are left that agree here: look up each with every few bits of the rest turned.
            bits = [8 * p + k for p in free if p not in more for k in range(8)]
            places = places[np.argsort(fps[places])]
            own = fps[places]
            for n in range(1, most_bits + 1):
                for turned in combinations(bits, n):
                    want = own ^ np.uint64(sum(1 << k for k in turned))
                    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    hit = np.flatnonzero(own[at] == want)
                    _hook(label, places[hit], places[at[hit]])


def _links_of_lists(keys: np.ndarray, fps: np.ndarray, most_bits: int):
    """Links (a, b), a spanning set for each list, of whole lists in order of their keys."""
    starts, stops = _runs(keys)
    sizes = stops - starts
    out = []
    short = np.repeat(sizes <= 16, sizes)
    for lag in range(1, 16):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:])
        if not len(i):
            break
        x = fps[i] ^ fps[i + lag]
        enough = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most_bits
        i, x = i[enough], x[enough]
        i = i[np.bitwise_count(x) <= most_bits]
        out.append((fps[i], fps[i + lag]))
    for k in np.flatnonzero(sizes > 16):
        own = fps[starts[k] : stops[k]]
        label = np.arange(len(own))
        if len(own) <= DENSE:
            _dense(own, label.copy(), label, most_bits)
        else:
            _long(own, KEYS[int(keys[starts[k]]) >> 24 & 7], label, most_bits)
        i = np.flatnonzero(label != np.arange(len(own)))
        out.append((own[label[i]], own[i]))
    return out


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Of distinct fingerprints __fp: links a, b that connect all that are within most_bits, none that are not.

    Each fingerprint goes to eight lists and each list gives fewer links than it has members, beyond a few members, so rows
    grow with the number of fingerprints alone.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the lists' keys find pairs of at most {MOST_BITS} differing bits")
    fp = F.col("__fp")
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
    key = lambda n, ps: F.lit(n << 24).cast("bigint").bitwiseOR(F.shiftleft(byte(ps[0]), 16)).bitwiseOR(F.shiftleft(byte(ps[1]), 8)).bitwiseOR(byte(ps[2]))
    lists = distinct.select("__fp", F.explode(F.array(*[key(n, ps) for n, ps in enumerate(KEYS)])).alias("__key"))
    lists = lists.repartition("__key").sortWithinPartitions("__key", "__fp")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        k0, f0 = [], []

        def found(keys, fps):
            for a, b in _links_of_lists(keys, fps, most_bits):
                if len(a):
                    yield batch_of(schema, [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))])

        held = 0
        for batch in batches:
            k0.append(batch.column(1).to_numpy(zero_copy_only=False))
            f0.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(k0[-1])
            if held < 200_000 or k0[0][0] == k0[-1][-1]:
                continue
            keys, fps = np.concatenate(k0), np.concatenate(f0)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
            yield from found(keys[:cut], fps[:cut])
            k0, f0 = [keys[cut:]], [fps[cut:]]
            held = len(keys) - cut
        if held:
            yield from found(np.concatenate(k0), np.concatenate(f0))

    return lists.select("__fp", "__key").mapInArrow(run, "a long, b long").distinct()


def _similar(own: np.ndarray, least: int) -> np.ndarray:
    """Of each sketch of a list the place of the one that it was reached from, or its own. The search spreads from sketch to sketch
    over those not reached yet, so every pair across two classes has been compared, and a group of copies costs one pass."""
    parent = np.arange(len(own))
    rest = np.arange(len(own))
    while len(rest) > 1:
        rest, front = rest[1:], rest[:1]
        while len(front) and len(rest):
            here, front = front[0], front[1:]
            near = (own[rest] == own[here]).sum(axis=1, dtype=np.int32) >= least
            parent[rest[near]] = here
            front = np.concatenate((front, rest[near]))
            rest = rest[~near]
    return parent


def _joins(sets: list[np.ndarray], rows: np.ndarray, first: int, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets of different classes, one for each two classes that they join. rows: the places of the sets, label: the class
    of each place, which follows the links. first: if not 0, pairs have one of the first so many sets, and one of the others.

    Similar sets share one of the rarest shingles of each, so many as either may have without the other: only sets that do are
    counted, all of them."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    if not len(values):
        return []
    row = np.repeat(np.arange(len(sets)), sizes)
    _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    ids = rank[ids]
    ids = ids[np.lexsort((ids, row))]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rare = np.flatnonzero(np.arange(len(ids)) - starts[row] <= (sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64))[row])
    rare = rare[np.argsort(ids[rare], kind="stable")]
    of, listed = label[rows], row[rare]
    low, high = _runs(ids[rare])
    several = np.minimum.reduceat(of[listed], low) < np.maximum.reduceat(of[listed], low)
    low, high = low[several], high[several]
    postings: dict[int, list[np.ndarray]] = {}
    classes, at, members = np.unique(of, return_inverse=True, return_counts=True)
    main = at == members.argmax()
    for a, z in zip(low.tolist(), high.tolist()):
        own = listed[a:z]
        for i in own[~main[own]].tolist():  # of each pair one is outside the largest class
            postings.setdefault(i, []).append(own)
    mark = np.zeros(len(counts), bool)
    out = []
    for i in sorted(postings):
        met = np.zeros(len(sets), bool)
        for own in postings.pop(i):
            met[own] = True
        near = np.flatnonzero(met)
        near = near[(main[near] | (near < i)) & (np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]))]
        if first:
            near = near[(near < first) != (i < first)]
        mark[ids[starts[i] : ends[i]]] = True
        while len(near := near[label[rows[near]] != label[rows[i]]]):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[near]), LOOKED_UP)))
            now, near = near[:n], near[n:]
            begin = np.cumsum(sizes[now]) - sizes[now]
            places = np.repeat(starts[now] - begin, sizes[now]) + np.arange(int(sizes[now].sum()))
            common = np.add.reduceat(mark[ids[places]], begin, dtype=np.int64)
            for j in now[common >= similarity * (sizes[now] + sizes[i] - common)].tolist():
                x, y = label[rows[i]], label[rows[j]]
                if x != y:
                    label[label == y] = x
                    out.append((int(rows[i]), int(rows[j])))
        mark[ids[starts[i] : ends[i]]] = False
    return out


def _joins_of_list(bodies: list[bytes], label: np.ndarray, shingle_words: int, similarity: float) -> list[tuple[int, int]]:
    """Links of similar texts of different classes of a list, as _joins has them. Sets are made of a block of texts and another at a time."""
    from zstandard import ZstdDecompressor

    read = ZstdDecompressor().decompress
    block = np.cumsum([len(b) for b in bodies]) // BLOCK_BYTES
    rows = [np.arange(a, z) for a, z in zip(*_runs(block))]
    sets_of = lambda places: [np.unique(shingle_hashes(read(bodies[p]).decode(), shingle_words)) for p in places.tolist()]
    out = []
    for n, own in enumerate(rows):
        if (label == label[0]).all():
            break
        sets = sets_of(own)
        out += _joins(sets, own, 0, label, similarity)
        for others in rows[n + 1 :]:
            both = np.concatenate((own, others))
            if (label[both] != label[own[0]]).any():
                out += _joins(sets + sets_of(others), both, len(own), label, similarity)
    return out


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Of sketch_lists __node, __key and __label of those that hold several classes, as a stored table. labels: __labelled and __label, the
    smallest node of a class; a node without is one by itself."""
    own = lists.select("__node", "__key").join(labels, F.col("__node") == F.col("__labelled"), "left").select("__node", "__key", F.coalesce("__label", "__node").alias("__label"))
    keys = own.groupBy(F.col("__key").alias("__several")).agg(F.min("__label").alias("__low"), F.max("__label").alias("__high")).filter("__low < __high").select("__several")
    keys = stored(keys, "keys")
    few = small(keys)
    return stored(own.join(keys if few is None else few, F.col("__key") == F.col("__several"), "left_semi"), "lists")


def joining_links(lists: DataFrame, bodies: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Of mixed_lists links a < b of similar texts that join the classes of a list, fewer than it has classes: all pairs of different classes are
    checked in the list's task, so no pairs travel. bodies: as exact_links has them."""
    asked = bodies_of(bodies, lists.select("__node")).select(F.col("__node").alias("__asked"), "__body")
    lists = lists.join(asked, F.col("__node") == F.col("__asked")).select("__node", "__body", "__key", "__label").repartition("__key").sortWithinPartitions("__key", "__node")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, ids, texts, classes = None, [], [], []

        def close():
            found = _joins_of_list(texts, np.array(classes, np.int64), shingle_words, similarity) if texts else []
            if found:
                ends = np.sort(np.array(ids, np.int64)[np.array(found)], axis=1)
                yield batch_of(schema, [pa.array(ends[:, 0]), pa.array(ends[:, 1])])

        for b in batches:
            for node, body, key, label in zip(*(b.column(c).to_pylist() for c in range(4))):
                if key != now:
                    yield from close()
                    now, ids, texts, classes = key, [], [], []
                ids.append(node)
                texts.append(body)
                classes.append(label)
        yield from close()

    return lists.mapInArrow(run, "a long, b long").distinct()


def sketch_lists(nodes: DataFrame) -> DataFrame:
    """Of distinct __node, __sketch and __bands: __key, __node and __sketch of the lists that two nodes or more share, as a stored table. Keys
    travel without sketches first, as most lists hold one node."""
    keys = nodes.select("__node", F.explode("__bands").alias("__key"))
    shared = keys.withColumn("__n", F.count("*").over(Window.partitionBy("__key"))).filter("__n > 1").select("__key", "__node")
    return stored(shared.join(nodes.select("__node", "__sketch"), "__node"), "lists")


def sketch_candidates(lists: DataFrame, similarity: float) -> DataFrame:
    """Of sketch_lists: pairs a < b of nodes that share a list and whose sketches are near enough: the steps of a search through each
    list, fewer than it has members. A list's members are compared in one task; copies have gone before.
    """
    least = least_equal(similarity)
    lists = lists.select("__node", "__sketch", "__key").repartition("__key").sortWithinPartitions("__key", "__node")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, ids, marks = None, [], []

        def close():
            if len(ids) < 2:
                return
            own = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, LANES)
            parent = _similar(own, least)
            i = np.flatnonzero(parent != np.arange(len(own)))
            if len(i):
                nodes = np.array(ids, np.int64)
                yield batch_of(schema, [pa.array(np.minimum(nodes[i], nodes[parent[i]])), pa.array(np.maximum(nodes[i], nodes[parent[i]]))])

        for b in batches:
            for node, mark, key in zip(*(b.column(c).to_pylist() for c in range(3))):
                if key != now:
                    yield from close()
                    now, ids, marks = key, [], []
                ids.append(node)
                marks.append(mark)
        yield from close()

    return lists.mapInArrow(run, "a long, b long").distinct()


def bodies_of(bodies: DataFrame, nodes: DataFrame) -> DataFrame:
    """__node and one __body of each of the nodes; of others too where the nodes are many."""
    if (few := small(nodes.select(F.col("__node").alias("__asked")).distinct())) is not None:
        bodies = bodies.join(few, F.col("__node") == F.col("__asked"), "left_semi")
    return bodies.groupBy("__node").agg(F.first("__body").alias("__body"))


def exact_links(candidates: DataFrame, bodies: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Of pairs a, b those whose sets of shingles have that Jaccard similarity or more. bodies: __node and __body, of a node any that
    it has."""
    candidates = stored(candidates, "candidates")
    bodies = bodies_of(bodies, candidates.select(F.col("a").alias("__node")).unionAll(candidates.select("b")))
    of = lambda side: bodies.select(F.col("__node").alias(f"__{side}"), F.col("__body").alias(f"__body_{side}"))
    both = candidates.join(of("a"), F.col("a") == F.col("__a")).join(of("b"), F.col("b") == F.col("__b")).select("a", "b", "__body_a", "__body_b")

    def run(batches):
        from zstandard import ZstdDecompressor

        read = ZstdDecompressor().decompress
        sets: dict[int, np.ndarray] = {}

        def of(node: int, body: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[node] = np.unique(shingle_hashes(read(body).decode(), shingle_words))
            return sets[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                p, q = of(a, x), of(b, y)
                # Sets of very different sizes can't be similar.
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Of links a, b: node and root, the smallest node that it reaches, for each node that has a link.

    Large-star and small-star steps in turn: each hooks all neighbours of a node to its smallest one, so the number of
    rounds grows with the logarithm of the longest chain. Every round is cut off with checkpoint().
    """
    shared_folder(edges.sparkSession)

    def star(e: DataFrame, both: bool) -> DataFrame:
        ordered = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        around = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else ordered
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        joined = around.join(least, around.u == least.w)
        if both:  # neighbours above the node
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # neighbours below it, and itself
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct().checkpoint()
    was = state(e)
    while was[0]:
        e = star(star(e, True), False).checkpoint()
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, most_bits: int = MOST_BITS, similarity: float | None = None) -> DataFrame:
    """One row for each row of df: its id, fingerprint (16 hex digits) and component_id, the smallest id that it reaches
    over links of at most most_bits differing bits, itself included. With a similarity, links are instead between texts whose sets of
    shingles have that Jaccard similarity or more: fingerprints and sketches give the candidates, the sets decide.

    Null and empty texts have the fingerprint zero and are linked like any other; their sets are equal. A null id gets the smallest id
    of its component too, null only where the component has no other. Repeated rows stay; an empty table gives no rows. Other columns
    are not looked at.
    """
    fps = stored(fingerprints(df, (id_col,), text_col, shingle_words, similarity is not None), "simhash")
    if similarity is None:
        fps = fps.withColumn("__node", F.col("__fp"))
        edges = links(fps.select("__fp").distinct(), most_bits)
    else:
        bodies = fps.select("__node", "__body")
        nodes = fps.groupBy("__node").agg(F.first("__sketch").alias("__sketch"), F.first("__bands").alias("__bands"))
        least = fps.groupBy("__fp").agg(F.min("__node").alias("__least")).checkpoint()
        of = lambda side: least.select(F.col("__fp").alias(side), F.col("__least").alias(f"__{side}"))
        by_bits = links(least.select("__fp"), most_bits).join(of("a"), "a").join(of("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
        same = fps.select("__fp", "__node").distinct().join(least, "__fp").filter(F.col("__node") != F.col("__least")).select(F.col("__node").alias("a"), F.col("__least").alias("b"))
        by_bits = by_bits.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        lists = sketch_lists(nodes)
        edges = stored(exact_links(by_bits.unionByName(sketch_candidates(lists, similarity)).distinct(), bodies, shingle_words, similarity), "links")
        # A candidate that fails may have stood between texts that other pairs would link: of each list all pairs are checked that no links
        # connect by then.
        labels = components(edges).select(F.col("node").alias("__labelled"), F.col("root").alias("__label"))
        lists = mixed_lists(lists, labels)
        if not lists.isEmpty():
            edges = stored(edges.unionByName(joining_links(lists, bodies, shingle_words, similarity)), "links")
            released(df.sparkSession)
    firsts = fps.groupBy("__node").agg(F.min(id_col).alias("__first"))
    roots = components(edges).checkpoint()
    smallest = roots.join(firsts, roots.node == firsts["__node"]).groupBy("root").agg(F.min("__first").alias("__least"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("__n"), "__least")
    labels = firsts.join(linked, firsts["__node"] == linked["__n"], "left").select(F.col("__node").alias("__f"), F.coalesce("__least", "__first").alias("component_id"))
    return fps.join(labels, fps["__node"] == labels["__f"]).select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, most_bits: int = MOST_BITS, similarity: float | None = 0.8) -> DataFrame:
    """df with one row of each group of near duplicates: the one with the smallest id. Columns stay as they are.

    Rows of equal id and text stay once; of rows of the smallest id with different texts in a group, the one with the smallest hash
    stays. Each group keeps a row, so an id whose texts are in several groups may stay more than once. Rows with null ids
    stay: they can't be told apart.
    """
    tie = F.xxhash64(text_col)
    named = df.filter(F.col(id_col).isNotNull())
    bodies = named.select(F.struct(F.col(id_col).alias("id"), tie.alias("tie")).alias("__id"), F.col(text_col).alias("__body"))
    groups = near_duplicates(bodies, "__id", "__body", shingle_words, most_bits, similarity)
    # The smallest id and tie of each group: a row of each, whatever other groups keep of the same id.
    firsts = groups.filter(F.col("__id") == F.col("component_id")).select(F.col("__id.id").alias("__i"), F.col("__id.tie").alias("__t")).distinct()
    kept = named.withColumn("__tie", tie).join(firsts, (F.col(id_col) == F.col("__i")) & (F.col("__tie") == F.col("__t")), "left_semi")
    return kept.dropDuplicates([id_col, "__tie"]).drop("__tie").unionByName(df.filter(F.col(id_col).isNull()))
