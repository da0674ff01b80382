"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A text is cut into leaves of about ``LEAF`` characters where a run of
non-blank characters meets a blank; no pre-token crosses such a place, so a
text's count is the sum of its leaves' counts. The tree holds, for every node,
characters and tokens below it. An edit descends to the leaves it touches,
takes in a neighbour where the place between them is no longer one where
nothing can cross, counts that region anew and corrects the sums up to the
root. Everything else keeps its counts.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import fresh, with_columns

LEAF = 512
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Remembered pieces per task, and their greatest length.
PIECES, PIECE_CHARS = 200_000, 64
#: A blank run with what follows it up to the next blank: ends only where no pre-token crosses.
_PIECE = re.compile(r"\s*\S+|\s+")


class Counter(dict):
    """Token counts of pieces, by the ranks of a public vocabulary."""

    def __init__(self, ranks: str | None = None):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(VOCABULARY), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _PIECE.findall(text)))


def leaves(text: str, size: int = LEAF) -> list[int]:
    """Lengths of the leaves: each ends at the first safe place at or after ``size`` characters."""
    out, start = [], 0
    while start < len(text):
        at = start + size
        while at < len(text) and not (text[at].isspace() and not text[at - 1].isspace()):
            at += 1
        at = min(at, len(text))
        out.append(at - start)
        start = at
    return out


class Tree:
    """Sums of characters and tokens in one array each: node i has the children 2i and 2i + 1, leaves come last."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.tokens = ([0] * (2 * self.width) for _ in range(2))
        self.chars[self.width : self.width + len(chars)] = chars
        self.tokens[self.width : self.width + len(tokens)] = tokens
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        """From stored node arrays."""
        tree = cls.__new__(cls)
        tree.width, tree.chars, tree.tokens = len(chars) // 2, list(chars), list(tokens)
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (or the last one with characters) and where it starts."""
        at = max(0, min(at, self.chars[1] - 1))
        i, start = 1, 0
        while i < self.width:
            left = self.chars[2 * i]
            if at < start + left:
                i = 2 * i
            else:
                i, start = 2 * i + 1, start + left
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """Replace text[start:end] by ``new``; the text after it, and how many characters were counted anew."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        after = text[:start] + new + text[end:]
        if not text:
            self.__init__([len(new)], [counter.count(new)])
            return after, len(new)
        first, low = self.leaf(start)
        last, at = self.leaf(max(start, end - 1))
        high = at + self.chars[last + self.width] + len(after) - len(text)
        while low > 0 and not safe(after, low):
            first -= 1
            low -= self.chars[first + self.width]
        while high < len(after) and not safe(after, high):
            last += 1
            high += self.chars[last + self.width]
        region = after[low:high]
        for i in range(first + 1, last + 1):
            if self.chars[i + self.width]:
                self.put(i, 0, 0)
        self.put(first, len(region), counter.count(region))
        return after, len(region)


def safe(text: str, at: int) -> bool:
    """No pre-token crosses the place before ``at``."""
    return at <= 0 or at >= len(text) or (text[at].isspace() and not text[at - 1].isspace())


_NODES = T.ArrayType(T.LongType())


def built(docs: DataFrame, text: str = "text", leaf: int = LEAF, ranks: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the tree's ``chars`` and ``tokens``, and its name. A null text has an empty tree."""
    (name,) = fresh(docs, "tree")

    def run(counter: Counter, column: pa.Array) -> list[pa.Array]:
        out = []
        for value in column.to_pylist():
            sizes = leaves(value or "", leaf)
            ends = np.cumsum([0, *sizes]).tolist()
            tree = Tree(sizes, [counter.count(value[s:e]) for s, e in zip(ends, ends[1:])])
            out.append({"chars": tree.chars, "tokens": tree.tokens})
        kind = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
        return [pa.array(out, kind)]

    field = T.StructField(name, T.StructType([T.StructField("chars", _NODES), T.StructField("tokens", _NODES)]))
    return with_columns(docs, [text], [field], run, lambda: Counter(ranks)), name


def edited(trees: DataFrame, tree: str, edits: str, text: str = "text", ranks: str | None = None) -> tuple[DataFrame, list[str]]:
    """Apply each document's edits to its text and tree.

    ``edits`` names a column array<struct<start, stop, new>>, applied in order,
    each to the text as the one before left it; positions beyond the text are
    drawn in, a null array is no edit, a null text stays null and counts 0.
    Returns the rows with the text and tree as they are afterwards, and the
    names of the new columns: tokens before, tokens after, characters counted
    anew.
    """
    names = fresh(trees, "tokens_before", "tokens_after", "chars_recounted")

    def run(counter: Counter, texts: pa.Array, states: pa.Array, changes: pa.Array) -> list[pa.Array]:
        out: list[tuple] = []
        for value, state, todo in zip(texts.to_pylist(), states.to_pylist(), changes.to_pylist()):
            kept = Tree.of(state["chars"], state["tokens"])
            before, again = kept.tokens[1], 0
            for e in todo or [] if value is not None else []:
                value, n = kept.edit(value, e["start"], e["stop"], e["new"] or "", counter)
                again += n
            out.append((value, {"chars": kept.chars, "tokens": kept.tokens}, before, kept.tokens[1], again))
        kinds = [pa.string(), states.type, pa.int64(), pa.int64(), pa.int64()]
        return [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]

    new_text, new_tree = fresh(trees, "new_text_", "new_tree_")
    fields = [T.StructField(new_text, T.StringType()), T.StructField(new_tree, trees.schema[tree].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in names]
    done = with_columns(trees, [text, tree, edits], fields, run, lambda: Counter(ranks))
    swap = {text: new_text, tree: new_tree}
    return done.select(*[F.col(swap.get(c, c)).alias(c) for c in trees.columns], *names), names


def revisions(text: Column, source: Column) -> Column:
    """A revision of each document made from its own columns: three edits spread over the text.

    The word at a third loses its first six characters, the source is inserted
    in the middle, and the last quarter of the shorter texts is replaced by the
    text's beginning.
    """
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    tag = F.concat(F.lit(" ["), F.coalesce(source, F.lit("?")), F.lit("]"))
    third, half, tail = (F.floor(n / 3).cast("long"), F.floor(n / 2).cast("long"), F.floor(n * 3 / 4).cast("long"))
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("stop"), new.alias("new"))
    return F.array(
        edit(third, third + 6, F.lit("")),
        edit(half, half, tag),
        edit(tail, F.when(n < 2000, n).otherwise(tail + 1), F.coalesce(F.substring(text, 1, 40), F.lit(""))),
    )
