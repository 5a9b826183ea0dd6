"""Evaluation texts inside training text: a generalised suffix automaton of the test items' words, streamed over every document.

The automaton of all items has at most twice as many states as the items have words. It is built on the driver and
broadcast; items of more than ``MOST_WORDS`` words together are cut into groups of that size by whole items, each with an
automaton of its own, and items beyond forty such groups come to the driver slice by slice.

Cases: null or empty texts give no rows; items shorter than ``least`` words can't be found; items with equal text are all
reported; repeated documents or items count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivan.llm.words import words

MOST_WORDS = 400_000


class SuffixAutomaton:
    """Of several word sequences; ``owners(state)``: the sequences that hold the state's strings."""

    def __init__(self, sequences: list[tuple[int, list[str]]]) -> None:
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, own = [-1], [0], [set()]
        for key, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), own)
                own[last].add(key)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            own[self.link[state]] |= own[state]
        own[0] = set()
        self.own = [tuple(x) for x in own]

    def _new(self, size: int, link: int, edges: dict[int, int], own: list) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        own.append(set())
        return len(self.size) - 1

    def _clone(self, p: int, q: int, w: int, own: list) -> int:
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]), own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, own: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w, own)
        new = self._new(self.size[last] + 1, 0, {}, own)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w, own)
        return new

    def matches(self, text: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever the longest suffix of text[:end] that an item holds has ``least`` words or more."""
        get, nxt, link, size = self.ids.get, self.next, self.link, self.size
        state = length = 0
        for end, word in enumerate(text, 1):
            w = get(word)
            if w is None:
                state = length = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state > 0 and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                length = size[state]
                if to is None:
                    state = length = 0
                    continue
            state = to
            length += 1
            if length >= least:
                yield end, length, state

    def spans(self, text: list[str], least: int) -> dict[int, list[list[int]]]:
        """Item -> merged [start, end) spans of the text's words that stand in it for ``least`` words or more."""
        out: dict[int, list[list[int]]] = {}
        for end, length, state in self.matches(text, least):
            reach = length
            while self.size[state] >= least:
                for item in self.own[state]:
                    mine = out.setdefault(item, [])
                    if mine and mine[-1][1] >= end - reach:
                        mine[-1] = [min(mine[-1][0], end - reach), max(mine[-1][1], end)]
                    else:
                        mine.append([end - reach, end])
                state = self.link[state]
                reach = self.size[state]
        return out


def _groups(items: list[tuple[int, list[str]]], most: int) -> list[list[tuple[int, list[str]]]]:
    groups, size = [[]], 0
    for key, ws in items:
        if groups[-1] and size + len(ws) > most:
            groups.append([])
            size = 0
        groups[-1].append((key, ws))
        size += len(ws)
    return groups


def automata(items: DataFrame, least: int) -> Iterator[Broadcast]:
    """Broadcast automata of about ``MOST_WORDS`` words each that together hold every item; items come to the driver in slices of some such groups."""
    spark = items.sparkSession
    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    n_words = rows.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = -(-n_words // (40 * MOST_WORDS)) or 1
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()
        sequences = [(r.item_id, ws) for r in sorted(part) if len(ws := words(r.text)) >= least]
        for group in _groups(sequences, MOST_WORDS):
            yield spark.sparkContext.broadcast(SuffixAutomaton(group))


def leaked(documents: DataFrame, items: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, item_id, n_words, longest, share): words of the document inside merged spans that stand in the item."""
    out = []
    key = items.schema["item_id"].dataType.simpleString()
    doc = documents.schema["doc_id"].dataType.simpleString()
    for automaton in automata(items, least):

        def scan(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            tree = automaton.value
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ws = words(text)
                    for item, spans in tree.spans(ws, least).items():
                        merged: list[list[int]] = []
                        for a, b in sorted(spans):
                            if merged and a <= merged[-1][1]:
                                merged[-1][1] = max(b, merged[-1][1])
                            else:
                                merged.append([a, b])
                        n = sum(b - a for a, b in merged)
                        found.append((doc_id, item, n, max(b - a for a, b in merged), n / len(ws)))
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64() if key == "bigint" else None), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.float64())],
                    names=["doc_id", "item_id", "n_words", "longest", "share"],
                )

        texts = documents.where("text is not null and text <> ''").select("doc_id", "text")
        out.append(texts.mapInArrow(scan, f"doc_id {doc}, item_id {key}, n_words int, longest int, share double"))
    return reduce(DataFrame.unionByName, out).dropDuplicates(["doc_id", "item_id"])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document has ten consecutive words of the item or more."""
    return leaked(documents, items).select("doc_id", "item_id")


def cleaned(documents: DataFrame, items: DataFrame, least: int = 10, most_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed_words, dropped): leaked spans cut out; a document whose leaked share exceeds ``most_share`` is dropped whole."""
    trees = list(automata(items, least))

    def clean(frames):
        from scrivan.llm.words import located

        for frame in frames:
            out = []
            for doc_id, text in zip(frame.doc_id, frame.text):
                places = located(text)
                hit = [False] * (len(places) + 1)
                ws = [w for w, _, _ in places]
                for tree in trees:
                    done = 0
                    for end, length, _ in tree.value.matches(ws, least):
                        for k in range(max(done, end - length), end):
                            hit[k] = True
                        done = end
                n = sum(hit)
                if n > most_share * max(1, len(places)):
                    out.append((doc_id, None, n, True))
                    continue
                kept, at, k = [], 0, 0
                while k < len(places):
                    if hit[k]:
                        first = k
                        while hit[k + 1]:
                            k += 1
                        kept.append(text[at : places[first][1]])
                        at = places[k][2]
                    k += 1
                kept.append(text[at:])
                out.append((doc_id, "".join(kept), n, False))
            import pandas as pd

            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_words", "dropped"])

    doc = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("text is not null").select("doc_id", "text").mapInPandas(clean, f"doc_id {doc}, text string, removed_words int, dropped boolean")
