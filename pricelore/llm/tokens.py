"""Token counts at every prefix of a text.

A piece model without normalisation never joins a word end to the space mark that follows it, so a text is a
sequence of units that are encoded alone. For a unit, prefix dynamic programming finds the last token of each prefix:
the one piece that ends there and stands next to the last token of the prefix before it exactly as the encoder leaves
the two. Counts add up along the text, so the exact token count of every prefix is known and questions about budgets and
truncation need no further encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, texts_of

MARK = "▁"
#: Units whose prefix counts a worker keeps for good, and those that it keeps for a while after that.
KEEP_UNITS, PASSING_UNITS = 600_000, 200_000
#: Longer units are counted anew each time, so that the table stays small.
LONGEST_KEPT = 64


class PrefixTable:
    """The token counts of all prefixes of one text: count(i) for its first i code points."""

    def __init__(self, starts: list[int], totals: list[int], parts: list[str], counter: PrefixCounter):
        self.starts, self.totals, self.parts, self.counter = starts, totals, parts, counter

    def count(self, i: int) -> int:
        if i <= 0:
            return 0
        at = bisect_right(self.starts, i) - 1
        base = self.totals[at - 1] if at else 0
        return base + self.counter.prefixes(self.parts[at])[i - self.starts[at]]

    def longest_within(self, budget: int) -> int:
        """The most code points that take no more than budget tokens."""
        last = len(self.starts) - 1
        for at in range(last, -1, -1):
            base = self.totals[at - 1] if at else 0
            if base > budget and base - budget > 2:
                continue
            counts = self.counter.prefixes(self.parts[at])
            for k in range(len(counts) - 1, -1, -1):
                if base + counts[k] <= budget:
                    return max(0, self.starts[at] + k)
        return 0


class PrefixCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        with open(model_path, "rb") as f:
            self.model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        m = self.model
        odd = "Á ﬁ  x"
        if m.decode(m.encode(odd)) != odd or m.encode("") != []:
            raise ValueError("the model normalises texts; prefix counts need one that does not")
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark after other characters")
        self.vocabulary = frozenset(pieces)
        self.longest = max(map(len, pieces))
        by_end: dict[str, set[int]] = {}
        for p in pieces:
            by_end.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in by_end.items()}
        self.together: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.totals: dict[str, int] = {}
        self.kept: dict[str, bytes | tuple[int, ...]] = {}
        self.passing: dict[str, bytes | tuple[int, ...]] = {}
        #: A line feed is no piece: what follows it is encoded as if nothing stood before.
        self.wall = len(m.encode("\n"))
        if "\n" in self.vocabulary:
            raise ValueError("the model has a piece for line feeds")

    def stays(self, a: str, b: str) -> bool:
        """Whether the encoder leaves a and b as two tokens when they stand side by side."""
        pieces = self.model.encode("\n" + (a + b).replace(MARK, " "), out_type=str)[self.wall :]
        return len(pieces) == 2 and pieces[0] == a

    def _extend(self, unit: str, counts: list[int], last: list[str]) -> None:
        """Carry the token counts of a unit's prefixes, and the last token of each, on from those that are there to its end."""
        vocabulary, lengths, together = self.vocabulary, self.lengths, self.together
        for i in range(len(counts), len(unit) + 1):
            c = unit[i - 1]
            for n in lengths.get(c, ()):
                if n > i:
                    continue
                piece = unit[i - n : i]
                if n > 1 and piece not in vocabulary:
                    continue
                before = last[i - n]
                if before:
                    try:
                        ok = together[before][piece]
                    except KeyError:
                        if self.pairs > 2_000_000:
                            together.clear()
                            self.pairs = 0
                        ok = together.setdefault(before, {})[piece] = self.stays(before, piece)
                        self.pairs += 1
                    if not ok:
                        continue
                counts.append(counts[i - n] + 1)
                last.append(piece)
                break
            else:  # no piece: one token for each of its bytes, and nothing joins across it
                counts.append(counts[-1] + len(c.encode()))
                last.append("")

    def learn(self, parts: set[str]) -> None:
        """Find the prefix counts of text parts that follow a space (index 0: the space mark is not there yet). In
        sorted order each begins as the one before it does, so only the rest is new."""
        unit, counts, last = "", [0], [""]
        for part in sorted(parts):
            before, unit = unit, MARK + part.replace(" ", MARK)
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extend(unit, counts, last)
            if len(part) > LONGEST_KEPT or counts[-1] > 255:
                continue
            if len(self.kept) < KEEP_UNITS:
                self.kept[part] = bytes(counts)
            else:
                if len(self.passing) >= PASSING_UNITS:
                    for p in self.passing:
                        del self.totals[p]
                    self.passing.clear()
                self.passing[part] = bytes(counts)
            self.totals[part] = counts[-1]

    def prefixes(self, part: str) -> list[int] | bytes:
        """Token counts of a part's prefixes."""
        known = self.kept.get(part) or self.passing.get(part)
        if known is None:
            known, last = [0], [""]
            self._extend(MARK + part.replace(" ", MARK), known, last)
        return known

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text in parts: the space before each is left out; further spaces before a part stay with it."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        out.append(" " * spaces + parts[-1])
        return out

    def totals_of(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        split = [self.parts(t) if t else [] for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        new.difference_update(self.totals)
        self.learn(new)
        get, out = self.totals.__getitem__, []
        for parts in split:
            try:
                out.append(sum(map(get, parts)))
            except KeyError:  # very long parts, and those that have passed since
                out.append(sum(n if (n := self.totals.get(p)) is not None else self.prefixes(p)[-1] for p in parts))
        return out

    def total(self, text: str) -> int:
        return self.totals_of([text])[0]

    def table(self, text: str) -> PrefixTable:
        """The token counts of every prefix of the text."""
        parts = self.parts(text) if text else [""]
        totals = list(accumulate(self.prefixes(p)[-1] for p in parts)) if text else [0]
        return PrefixTable(_starts(parts), totals, parts, self)


def _starts(parts: list[str]) -> list[int]:
    """For each part, the code points before it, less the mark that only the encoder puts before the text."""
    out, at = [], -1
    for p in parts:
        out.append(at)
        at += len(p) + 1
    return out


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = 4096) -> DataFrame:
    """The kept columns with n_bytes, n_tokens, over_limit and limit_chars: the most code points from the start that
    take no more than limit tokens, read from the prefix table.

    A null text is empty: no bytes, no tokens. Rows stand for themselves: repeated ones are each counted. The path of
    the model must lead to the file on every machine.
    """
    kept = texts_of(df, text_col, *keep)
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("limit_chars", T.LongType())))])
    arrow: pa.Schema = to_arrow_schema(schema)

    def run(batches):
        count = counter(model_path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            totals = count.totals_of(texts)
            chars = [len(t) if n <= limit else count.table(t).longest_within(limit) for t, n in zip(texts, totals)]
            yield batch_of(arrow, [*[b.column(i).cast(arrow.field(i).type) for i in range(len(fields))], [len(t.encode()) for t in texts], totals, [n > limit for n in totals], chars])

    return kept.mapInArrow(run, schema)
