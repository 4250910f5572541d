"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the vocabulary's pattern; no token spans two of them.  The tree's
leaves are runs of pre-tokens with their lengths and token counts, its inner nodes the sums, so the
count of a whole text is at the root and any position is found in logarithmic time.  An edit cuts
anew from the last boundary that cannot depend on the edited characters, and stops as soon as a new
boundary behind the edit meets an old one: from there on the same characters follow, so the old
pre-tokens stand.  Only the new pre-tokens are encoded, and only the sums above them change.

Defined results: a null text counts as an empty one, of no tokens; edits are clipped to the text
as it then is, a null list of edits is an empty one, a null replacement is an empty one; rows with
a repeated or null doc_id are counted on their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Bpe, bpe
from .common import python_ready, table

LEAF = 64
#: A boundary this many characters before an edit is fixed: the pattern looks at most two ahead.
LOOK_AHEAD = 3
#: Pre-tokens whose counts a worker remembers at a time.
REMEMBERED = 200_000

SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_tokens long, edited_chars long, edited_pretokens long, edited_tokens long, reencoded_pretokens long"


class Counter:
    """Token counts of single pre-tokens."""

    def __init__(self, coder: Bpe):
        self.coder, self.known = coder, {}
        self.cut = regex.compile(coder.pattern)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = known.get(p)
                    if n is None:
                        n = len(self.coder.ids(p))
                        if len(p) <= 64:
                            known[p] = n
                    out[i] = n
        return out


class TokenTree:
    """A text, its pre-tokens in leaves, and the sums (characters, pre-tokens, tokens) above them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.cut.findall(text)
        self._build(list(map(len, pieces)), counter.counts(pieces))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length() if len(self.leaves) > 1 else 1
        empty = (0, 0, 0)
        self.sums = [empty] * self.size + [(sum(a), len(a), sum(b)) for a, b in self.leaves] + [empty] * (self.size - len(self.leaves))
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    @property
    def pretokens(self) -> int:
        return self.sums[1][1]

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the position, and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            left = self.sums[2 * i][0]
            if position < begin + left or not self.sums[2 * i + 1][1]:
                i = 2 * i
            else:
                begin, i = begin + left, 2 * i + 1
        return i - self.size, begin

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from start to before end."""
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        self.text = text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        first, begin = self._find(max(0, start - LOOK_AHEAD))
        lengths, counts = self.leaves[first]
        at, k = begin, 0
        while k < len(lengths) and at + lengths[k] <= start - LOOK_AHEAD:
            at += lengths[k]
            k += 1
        head = (lengths[:k], counts[:k])
        # Old boundaries from here on, and new pre-tokens until the two meet behind the edit.
        leaf, old_k, old = first, k, at
        pieces: list[str] = []
        new = at
        while True:
            if new >= start + len(replacement):
                while old < new - shift or old < end:
                    while leaf < len(self.leaves) and old_k >= len(self.leaves[leaf][0]):
                        leaf, old_k = leaf + 1, 0
                    if leaf >= len(self.leaves):
                        break
                    old += self.leaves[leaf][0][old_k]
                    old_k += 1
                if old == new - shift and old >= end:
                    break
            m = self.counter.cut.match(text, new)
            if m is None:
                break
            pieces.append(m[0])
            new = m.end()
        if new >= len(text):
            leaf, old_k = len(self.leaves) - 1, len(self.leaves[-1][0])
        elif leaf >= len(self.leaves):
            leaf, old_k = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(pieces)
        tail = self.leaves[leaf]
        merged = (head[0] + list(map(len, pieces)) + tail[0][old_k:], head[1] + self.counter.counts(pieces) + tail[1][old_k:])
        if len(merged[0]) > 8 * LEAF:
            lengths, counts = [], []
            for part in (*self.leaves[:first], merged, *self.leaves[leaf + 1 :]):
                lengths += part[0]
                counts += part[1]
            self._build(lengths, counts)
            return
        for i in range(first, leaf + 1):
            self.leaves[i] = merged if i == first else ([], [])
            j = i + self.size
            self.sums[j] = (sum(self.leaves[i][0]), len(self.leaves[i][0]), sum(self.leaves[i][1]))
            while j > 1:
                j //= 2
                self._sum(j)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of each text before and after its edits; see SCHEMA.

    docs: doc_id, text, edits array<struct<begin: int, finish: int, words: string>>; each edit's
    positions are code points of the text as the edits before it left it.
    """
    python_ready(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bpe(vocabulary))
        for b in batches:
            rows = []
            for key, text, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = TokenTree(text, counter)
                before = (len(text), tree.pretokens, tree.tokens)
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["begin"] or 0, e["finish"] or 0, e["words"] or "")
                rows.append((key, *before, len(tree.text), tree.pretokens, tree.tokens, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return plain.mapInArrow(run, SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each: words put in after a third, a cut in the middle, a new beginning."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")

    def edit(begin, finish, words):
        return F.struct(begin.cast("int").alias("begin"), finish.cast("int").alias("finish"), words.alias("words"))

    edits = F.array(edit(third, third, F.lit(" some words put in,")), edit(half, half + 24, F.lit("")), edit(F.lit(0), F.lit(5), F.lit("It's 2 new\n\n  words")))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(sample_edits(table(spark, sf_dir, "documents")))
