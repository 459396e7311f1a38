"""Secrets in texts: three fixed kinds by pattern, and random strings by how badly a byte-pair vocabulary packs them.

A vocabulary learned from prose needs about one token for three or more characters of words and names, but close to one
for two characters of a random key. Digests of usual lengths, UUIDs, plain numbers and identifiers are put aside before that
test; an identifier is one only if its parts, in lower case, take few tokens themselves.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, texts_of

#: Fixed patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: A candidate for the token test: a run of key characters, this long at least.
LEAST_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: What joins the words of an identifier, and its parts between: words, in any of the usual ways of joining them, with a number
#: after a word at most.
JOINTS = re.compile(r"[_/+=-]+")
WORDS = re.compile(r"[A-Z]?[a-z]*(?:[A-Z][a-z]{2,})*[0-9]{0,4}\Z")
CAPITALS = re.compile(r"[A-Z]*\Z")
#: The word parts of an identifier.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Characters a token under which a run counts as random.
CHARS_PER_TOKEN = 2.2


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the three base kinds: leftmost, not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """Whether a run is made of words alone, or of capitals with a number after the last, or of numbers alone. Each part is
    looked at once."""
    parts = JOINTS.split(run)
    if all(WORDS.match(x) for x in parts) or all(x.isdigit() or not x for x in parts):
        return True
    return all(CAPITALS.match(x) for x in parts[:-1]) and len(parts[-1]) - len(last := parts[-1].rstrip("0123456789")) <= 4 and bool(CAPITALS.match(last))


def random_spans(text: str, encode, chars_per_token: float = CHARS_PER_TOKEN, digests: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """Runs of key characters that take many tokens, without known digests (listed ones, and any of a digest's form)
    and identifiers, whose word parts take few. The run is the leftmost longest, in code points; runs of fewer than LEAST_RUN
    characters, without the joints at their ends, are not tested: they have too few tokens for a ratio."""
    out = []
    for m in RUN.finditer(text):
        run = m.group().strip("=-_/+")
        if run.isdigit() or len(run) < LEAST_RUN:
            continue
        if run in digests or DIGEST.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run):
            continue
        if is_identifier(run):
            parts = [x.lower() for x in PART.findall(run)]
            if sum(map(len, parts)) >= chars_per_token * sum(len(encode(x)) for x in parts):
                continue
        if len(run) < chars_per_token * len(encode(run)):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(df: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", chars_per_token: float = CHARS_PER_TOKEN, digests: frozenset[str] = frozenset()) -> DataFrame:
    """The kept columns with n_assign, n_access, n_hex, base_sha256, spans and n_random.

    Spans are kind:start:end in code points, end exclusive, ordered by start, then by kind. A null text is empty: no
    spans, and the digest of the empty string. Each row stands for itself. The path must lead to the ranks file on every
    machine; digests are strings known to be harmless, a short list.
    """
    kept = texts_of(df, text_col, *keep)
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_random", T.LongType())))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode = encoder(ranks_path, pattern).encode_ordinary
        for b in batches:
            counts, shas, spans = ([], [], [], []), [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                base = base_spans(t)
                every = base + random_spans(t, encode, chars_per_token, digests)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield batch_of(arrow, [*[b.column(i).cast(arrow.field(i).type) for i in range(len(fields))], *counts[:3], shas, spans, counts[3]])

    return kept.mapInArrow(run, schema)
