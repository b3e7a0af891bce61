"""Problem 8: evaluation texts leaking into training text.

Every run of ``span`` consecutive words of an evaluation item is a pattern of one Aho-Corasick automaton over words. A document is split
into words once, mapped to the automaton's word numbers and scanned once; matches are mapped back to character offsets of the original.
The automaton holds at most ``block_words`` item words; more items make more automatons, each scanned by its own pass, so no broadcast grows
beyond that bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, start int, end int, words int"


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in lower case."""
    return [w.lower() for w in WORD.findall(text or "")]


_BUILT: dict[tuple, tuple] = {}


def held_automaton(mark: str, items: list[tuple[int, str]], span: int, least: int):
    """The automaton of a broadcast block, built once in a Python worker however many tasks it runs; the block before is dropped."""
    if (mark, span, least) not in _BUILT:
        _BUILT.clear()
        _BUILT[mark, span, least] = automaton(items, span, least)
    return _BUILT[mark, span, least]


def automaton(items: list[tuple[int, str]], span: int, least: int = 5):
    """The automaton, its word numbers (0: no item's word) and, per pattern, the items it stands in. Items of ``least`` to ``span`` - 1 words are one
    pattern as a whole."""
    import ahocorasick

    number: dict[str, int] = {}
    patterns: dict[tuple, set] = {}
    for item, text in items:
        seq = [number.setdefault(w, len(number) + 1) for w in words(text)]
        for k in range(len(seq) - span + 1):
            patterns.setdefault(tuple(seq[k : k + span]), set()).add(item)
        if least <= len(seq) < span:
            patterns.setdefault(tuple(seq), set()).add(item)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p, where in patterns.items():
        auto.add_word(p, (len(p), tuple(sorted(where))))
    if patterns:
        auto.make_automaton()
    return (auto if patterns else None), number


def matches(text: str | None, auto, number: dict[str, int], span: int) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of each maximal run of ``span`` or more words of an item, and of each shorter item as a whole; offsets are of the text as
    given."""
    if auto is None or not text:
        return []
    seq = tuple([number.get(w.lower(), 0) for w in WORD.findall(text)])
    runs: dict[int, list[list[int]]] = {}
    for end, (size, where) in auto.iter(seq):
        for item in where:
            have = runs.setdefault(item, [])
            if have and have[-1][1] == end - 1 and size == span:
                have[-1][1] = end
            else:
                have.append([end - size + 1, end])
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(item, at[a][0], at[b][1], b - a + 1) for item, have in runs.items() for a, b in have]


def leaks(docs: DataFrame, items: DataFrame, span: int = 12, block_words: int = 500_000, least: int = 5) -> DataFrame:
    """(doc_id, item_id, start, end, words) of documents (doc_id, text) holding ``span`` or more consecutive words of an item (item_id,
    item_text), or the whole of an item of ``least`` to ``span`` - 1 words. Null and empty texts hold nothing; repeated rows are reported once each.
    """
    spark = docs.sparkSession
    src = items.filter(F.col("item_text").isNotNull()).select("item_id", "item_text").distinct()
    size = F.size(F.split("item_text", r"\W+")).alias("n")
    total = src.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_words))
    parts = []
    for k in range(blocks):
        mine = [tuple(r) for r in src.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        held = spark.sparkContext.broadcast(mine)

        def scan(batches: Iterator[pd.DataFrame], held=held, mark=uuid4().hex) -> Iterator[pd.DataFrame]:
            auto, number = held_automaton(mark, held.value, span, least)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.doc_id, b.text) for m in matches(t, auto, number, span)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "words"])

        parts.append(spread(docs.select("doc_id", "text")).mapInPandas(scan, FOUND))
    return reduce(DataFrame.unionByName, parts)
