"""Small tables and brute-force versions for the operators' tests."""

from __future__ import annotations

import re

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text: str) -> str:
    return text.translate(ASCII_LOWER)


def docs_of(spark, texts, first: int = 0):
    rows = [(i + first, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, k: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots(n_or_ids, pairs) -> dict:
    """Smallest reachable id of each id."""
    parent = {i: i for i in n_or_ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def near_components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return roots(ids, pairs)
