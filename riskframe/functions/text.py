"""Text functions: tokens, token estimates, injection and PII patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.columns import col, strip

# Fixed value: whitespace as Python's ``str.split()`` sees it; ``\\s`` alone is ASCII only.
SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits; null gives no tokens."""
    text = F.coalesce(col(c), F.lit(""))
    # lower-casing first is not equivalent: it maps a few non-ASCII capitals to ASCII letters
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)


#: Bytes of text whose tokens are looked for at a time.
STRETCH = 1 << 20
#: The lower-case letter or digit that a byte stands for, 0 for all others.
_PLAIN = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _PLAIN[_c] = _PLAIN[ord(chr(_c).upper())] = _c


def token_codes(texts: pa.Array, stretch: int = STRETCH) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """The tokens of `tokenize` in a task, some texts of about ``stretch`` bytes at a time.

    Gives the place of the first text, the distinct tokens, the number of each
    token in turn among these, and how many tokens each text has.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + stretch, "right")) - 1)
        plain = _PLAIN[data[offsets[a] : offsets[b]]]
        edges = offsets[a : b + 1] - offsets[a]
        inside = plain != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts, ends = (e[e < len(plain)] for e in (edges[:-1], edges[1:]))
        first[starts] = inside[starts]  # a token does not go on in the next text
        last[ends - 1] = inside[ends - 1]
        begins = np.flatnonzero(first)
        cuts = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(np.flatnonzero(last) - begins + 1, out=cuts[1:])
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(cuts), pa.py_buffer(plain[inside]))
        coded = words.cast(pa.string()).dictionary_encode()
        yield a, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(begins, edges))
        a = b


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(strip(F.coalesce(col(c), F.lit(""))), SPACES), lambda w: w != ""))


def token_estimate(c: Column | str) -> Column:
    """About 1.3 tokens per word, plus one; never below one."""
    return (F.floor(word_count(c) * F.lit(1.3)) + 1).cast("bigint")
