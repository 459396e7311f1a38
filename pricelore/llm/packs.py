"""Token ids of texts in a binary format of independently compressed documents.

A dataset has two tables in one folder. `dictionary` has one row: a zstandard dictionary trained on serialised id
arrays of a bounded sample, and its SHA-256. `packs` has rows of some megabytes each, in ascending order of document ids:
the dictionary's hash, the ids of the documents, the token counts, the offsets of the frames in the payload, and the payload,
one zstandard frame a document. A document is read by its offset alone, and only its own frame is decompressed. Ids are
little-endian, 2 bytes each if the vocabulary allows it, else 4.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, texts_of

#: Rows of the sample on which the dictionary is trained, the characters of each that are used, and the dictionary's bytes.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4_000, 65_536
PACK_BYTES, PACK_DOCS = 2_000_000, 4_096
LEVEL = 3
#: Distinct text parts whose ids a worker keeps for good, and those that it keeps for a while after that.
KEEP_PARTS, PASSING_PARTS = 900_000, 200_000
#: The place before a single space between two characters that are not white space: no token of a byte-level pre-tokenizer that puts spaces before words crosses it.
_CUT = re.compile(r" (?=\S)(?<=\S )")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them. Texts are cut where no token crosses, and the ids of a
    part that was encoded before are reused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = json.loads(text)
        added = kind.get("added_tokens") or []
        pre = kind.get("pre_tokenizer") or {}
        #: Whether texts may be cut at all.
        self.cuts = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        self.added = added
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that a token stands for: in this kind of vocabulary each is one character.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.widths[i] = len(piece)
        self.marks: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}
        self.passing: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The serialised ids of each text."""
        if not self.cuts:
            return self._ids(texts)
        kept, passing = self.kept, self.passing
        split = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for parts in split:
            seen.update(parts[1:])
        new = seen.difference(kept)
        # A cut beside more white space, or at the end, is none: those texts are cut again with care.
        wrong = {p for p in new if p.strip() != p or not p}
        for i, parts in enumerate(split):
            head = parts[0]
            if wrong and not wrong.isdisjoint(parts) or not head or head[-1].isspace():
                split[i] = _CUT.split(texts[i])
                new.update(p for p in split[i][1:] if p not in kept)
        # What begins or ends with white space is not remembered, so that it shows up as new wherever it stands.
        odd = [p for p in new if p.strip() != p or not p] if wrong else []
        new.difference_update(odd)
        once = dict(zip(odd, self._ids([" " + p for p in odd]))) if odd else {}
        if len(passing) > PASSING_PARTS:
            passing.clear()
        new.difference_update(passing)
        self._learn(new)
        out = []
        for head, parts in zip(self._ids([parts[0] for parts in split]), split):
            try:
                out.append(head + b"".join(map(kept.__getitem__, parts[1:])))
            except KeyError:
                out.append(head + b"".join([ids if (ids := kept.get(p)) is not None else ids if (ids := passing.get(p)) is not None else once[p] for p in parts[1:]]))
        return out

    def _learn(self, new: set[str]) -> None:
        """Find the ids of parts that follow a space. A word with a mark after it is the word's ids and the mark's."""
        marked = {p: word for p in new if p[-1] in ".,;:!?" and (word := p[:-1]).isalpha()}
        kept, passing = self.kept, self.passing
        plain = list((new - marked.keys()).union(w for w in marked.values() if w not in kept and w not in passing))
        if len(kept) + len(plain) < KEEP_PARTS and max(map(len, plain), default=0) <= 64:
            kept.update(zip(plain, self._many(plain)))
        else:
            for part, ids in zip(plain, self._many(plain)):
                (kept if len(kept) < KEEP_PARTS and len(part) <= 64 else passing)[part] = ids
        for part, word in marked.items():
            mark = self.marks.get(part[-1])
            if mark is None:
                mark = self.marks[part[-1]] = self._ids([part[-1]])[0]
            ids = kept.get(word)
            (kept if len(kept) < KEEP_PARTS and len(part) <= 64 else passing)[part] = (passing[word] if ids is None else ids) + mark

    def _many(self, parts: list[str]) -> list[bytes]:
        """The ids of each part after a space. Parts go to the library a thousand at a time as one text: the cuts between
        them are such as no token crosses, and the bytes of every token tell where each ends."""
        out: list[bytes] = []
        for at in range(0, len(parts), 1000):
            own = [" " + p for p in parts[at : at + 1000]]
            if any(t["content"] in p for t in self.added for p in own):
                out += self._ids(own)
                continue
            joined = "".join(own)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.type)
            ends = np.cumsum(self.widths[ids])
            sizes = [len(p) for p in own] if joined.isascii() else [len(p.encode()) for p in own]
            cuts = (np.searchsorted(ends, np.cumsum(sizes)) + 1) * self.type.itemsize
            raw, a = ids.tobytes(), 0
            for z in cuts.tolist():
                out.append(raw[a:z])
                a = z
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from one text of each of the sample_rows ids with the smallest hashes: a fixed number, whatever the
    table's size. Too few or too short texts give an empty dictionary, which stands for none."""
    import zstandard

    spark = df.sparkSession
    ids = df.select(F.col(f"`{id_col}`").cast("bigint").alias("__i")).filter(F.col("__i").isNotNull()).select(F.xxhash64("__i").alias("h"), "__i")
    # Tasks send ids alone; texts are fetched for the chosen ones.
    chosen = spark.createDataFrame(ids.distinct().orderBy("h", "__i").limit(sample_rows).collect(), ids.schema)
    texts = df.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.substring(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 1, SAMPLE_CHARS).alias("__t"))
    sample = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__i")).groupBy("h", "__i").agg(F.min("__t").alias("t"))
    ids = encoder(tokenizer_path).encode([r.t for r in sorted(sample.collect(), key=lambda r: (r.h, r["__i"]))])
    try:
        return zstandard.train_dictionary(dictionary_bytes, [x for x in ids if x]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


PACKS = "part int, pack int, dict_sha256 string, width int, n_docs int, n_tokens long, doc_ids array<long>, counts array<long>, offsets binary, payload binary"


def write_packs(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> None:
    """Write the token ids of df's texts under path, in ascending order of id_col (null first; equal ids by a hash of the
    text), each document ended by end_id. Null texts are empty: the end id alone."""
    spark = df.sparkSession
    dictionary = train_dictionary(df, tokenizer_path, id_col, text_col)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    rows = texts_of(df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__body")), "__body", "__id").withColumn("__tie", F.xxhash64("__text"))
    # The number of partitions follows from the session's setting, as in any shuffle.
    ordered = rows.repartitionByRange(F.col("__id").asc_nulls_first(), "__tie").sortWithinPartitions(F.col("__id").asc_nulls_first(), "__tie").select("__id", F.spark_partition_id().alias("__part"), "__text")

    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("pack", pa.int32()), ("dict_sha256", pa.string()), ("width", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary())])
        enc = encoder(tokenizer_path)
        compress = _codec(shared.value)[0].compress
        end = b"" if end_id is None else np.array([end_id], enc.type).tobytes()
        ids, counts, frames, held, pack, part = [], [], [], 0, 0, 0

        def packed():
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames]))).astype("<u8").tobytes()
            return batch_of(schema, [[part], [pack], [sha], [enc.type.itemsize], [len(ids)], [sum(counts)], [ids], [counts], [offsets], [b"".join(frames)]])

        for b in batches:
            part = b.column(1)[0].as_py() if b.num_rows else part
            for i, x in zip(b.column(0).to_pylist(), enc.encode(b.column(2).to_pylist())):
                frames.append(compress(x + end))
                ids.append(i)
                counts.append((len(x) + len(end)) // enc.type.itemsize)
                held += len(frames[-1])
                if held >= PACK_BYTES or len(ids) >= PACK_DOCS:
                    yield packed()
                    ids, counts, frames, held, pack = [], [], [], 0, pack + 1
        if ids:
            yield packed()

    ordered.mapInArrow(run, PACKS).write.parquet(f"{path}/packs")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not match its hash")
    return row.dict_sha256, dictionary


def read_packs(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), and with with_ids the ids."""
    sha, dictionary = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast((sha, dictionary))
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    # Sums over partitions first, so that no window holds more rows than there are partitions, or packs in one.
    parts = packs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = packs.select("part", "pack", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    starts = starts.join(parts, starts.part == parts.p).select(F.col("part").alias("p"), F.col("pack").alias("k"), (F.col("before") + F.col("inside")).alias("start"))
    whole = packs.join(starts, (packs.part == starts.p) & (packs["pack"] == starts.k)).select("start", "dict_sha256", "width", "doc_ids", "offsets", "payload")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches):
        schema = pa.schema(fields)
        want, dictionary = shared.value
        decompress = _codec(dictionary)[1].decompress
        for b in batches:
            for k in range(b.num_rows):
                start, got, width, doc_ids, offsets, payload = (b.column(c)[k].as_py() for c in range(6))
                if got != want:
                    raise ValueError("a pack was written with another dictionary")
                edges = np.frombuffer(offsets, "<u8").tolist()
                cols: list[list] = [[] for _ in fields]
                for i, a, z in zip(doc_ids, edges, edges[1:]):
                    ids = np.frombuffer(decompress(payload[a:z]), f"<u{width}")
                    for c, v in zip(cols, (i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32))):
                        c.append(v)
                    start += len(ids)
                yield batch_of(schema, cols)

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id: of each its frame alone is decompressed."""
    sha, dictionary = _dictionary(spark, path)
    decompress = _codec(dictionary)[1].decompress
    out = []
    for r in spark.read.schema(PACKS).parquet(f"{path}/packs").filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).toLocalIterator():
        if r.dict_sha256 != sha:
            raise ValueError("a pack was written with another dictionary")
        edges = np.frombuffer(bytes(r.offsets), "<u8").tolist()
        for i, a, z in zip(r.doc_ids, edges, edges[1:]):
            if i == doc_id:
                out.append(np.frombuffer(decompress(bytes(r.payload)[a:z]), f"<u{r.width}").tolist())
    return out
