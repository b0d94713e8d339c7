"""Problem 6: evaluation passages inside corpus documents.

The normalised items form one generalised suffix automaton over words, built once on the
driver and kept as flat arrays (a hash table of transitions, links, lengths), about
100 bytes an item word. Documents stream past it, thousands of stretches in step: at each
word the automaton yields the length of the longest match that ends there, and a match of
at least `least` words names the items that hold its last `least` words in that order.
Items come in automata of at most `block_words` words, so what is sent to the executors
is bounded for any number of items; what they find is merged per document, so that no
result depends on the blocks.

Words are runs of letters and digits in lower case; a hyphen directly before a line
break goes together with the break. Defined results: null and empty texts and items
match nothing, an item of fewer than `least` words can't be found, repeated items are
found each, several texts of one item id are one item, a null id is left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.session import materialize

LEAST = 16
#: Item words of one automaton, and words that a stretch is cut into when it is streamed.
BLOCK, PIECE = 4_000_000, 1024
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"-\r?\n")


def words(text: str) -> list[str]:
    return _WORD.findall(_BREAK.sub("", text).lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with positions in the text as stored; a word may reach over a hyphenated break."""
    cuts = [m.span() for m in _BREAK.finditer(text)]
    gone = np.cumsum([0] + [e - s for s, e in cuts])
    # where in the flat text each cut lies: characters from there on are shifted by all that was cut before
    at = np.array([s for s, _ in cuts], np.int64) - gone[:-1]
    found = [(m.group().lower(), m.start(), m.end() - 1) for m in _WORD.finditer(_BREAK.sub("", text))]
    first, last = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
    shift = lambda p: p + gone[np.searchsorted(at, p, side="right")]
    return [(w, int(s), int(e) + 1) for (w, _, _), s, e in zip(found, shift(first), shift(last))]


def _slot(state, word):
    return (state * 0x9E3779B1 + word * 0x85EBCA6B) & 0x7FFFFFFFFFFF


class SuffixAutomaton:
    """Of several word sequences (item id, words), as flat arrays."""

    def __init__(self, sequences: list[tuple[int, list[str]]], least: int):
        self.least = least
        ids: dict[str, int] = {}
        coded = [(item, [ids.setdefault(w, len(ids)) for w in ws]) for item, ws in sequences]
        self.ids, n = ids, max(1, len(ids))
        self.bits = n.bit_length()
        total = sum(len(c) for _, c in coded)
        # at most 3 transitions an item word
        self.mask = (1 << max(4, (4 * total).bit_length())) - 1
        self._key, self._to = array("q", [-1]) * (self.mask + 1), array("i", [0]) * (self.mask + 1)
        self._link, self._len, self._head = array("i", [-1]), array("i", [0]), array("i", [-1])
        self._edge_word, self._edge_next = array("i"), array("i")
        for _, c in coded:
            last = 0
            for w in c:
                last = self._extend(last, w)
        self.key, self.to = np.frombuffer(self._key, np.int64), np.frombuffer(self._to, np.int32)
        self.link, self.len = np.frombuffer(self._link, np.int32), np.frombuffer(self._len, np.int32)
        del self._key, self._to, self._link, self._len, self._head, self._edge_word, self._edge_next
        # for each state the ancestor that stands for the last `least` words of a match
        up = np.maximum(self.link, 0)
        named = np.where(self.len[up] >= least, up, np.arange(len(up), dtype=np.int32))
        while True:
            further = named[named]
            if np.array_equal(further, named):
                break
            named = further
        self.named = np.where(self.len >= least, named, -1).astype(np.int32)
        self._name_items(coded)

    # construction

    def _get(self, state: int, w: int) -> int:
        key, at = state << self.bits | w, _slot(state, w) & self.mask
        while self._key[at] != key:
            if self._key[at] < 0:
                return -1
            at = (at + 1) & self.mask
        return self._to[at]

    def _put(self, state: int, w: int, to: int) -> None:
        key, at = state << self.bits | w, _slot(state, w) & self.mask
        while self._key[at] >= 0 and self._key[at] != key:
            at = (at + 1) & self.mask
        if self._key[at] < 0:
            self._key[at] = key
            self._edge_word.append(w)
            self._edge_next.append(self._head[state])
            self._head[state] = len(self._edge_word) - 1
        self._to[at] = to

    def _new(self, length: int, link: int = 0) -> int:
        self._link.append(link)
        self._len.append(length)
        self._head.append(-1)
        return len(self._len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._new(self._len[p] + 1, self._link[q])
        edge = self._head[q]
        while edge >= 0:
            word = self._edge_word[edge]
            self._put(copy, word, self._get(q, word))
            edge = self._edge_next[edge]
        self._link[q] = copy
        while p >= 0 and self._get(p, w) == q:
            self._put(p, w, copy)
            p = self._link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self._get(last, w)
        if q >= 0:
            return q if self._len[q] == self._len[last] + 1 else self._split(last, q, w)
        new, p = self._new(self._len[last] + 1), last
        while p >= 0 and (q := self._get(p, w)) < 0:
            self._put(p, w, new)
            p = self._link[p]
        if p >= 0:
            self._link[new] = q if self._len[q] == self._len[p] + 1 else self._split(p, q, w)
        return new

    def _name_items(self, coded: list[tuple[int, list[int]]]) -> None:
        """item_of[item_at[s] : item_at[s + 1]] are the items of a named state s; text_of holds each item's words, a gap between its texts."""
        names, flat = sorted({item for item, _ in coded}), {}
        lanes = [np.array(c, np.int64) for _, c in coded]
        lane, _, n, state = self.stream(lanes)
        number = {item: i for i, item in enumerate(names)}
        own = np.array([number[item] for item, _ in coded], np.int64)
        pairs = np.unique(np.stack([self.named[state], own[lane]], axis=1), axis=0) if len(lane) else np.zeros((0, 2), np.int64)
        self.item_at = np.zeros(len(self.len) + 1, np.int64)
        np.add.at(self.item_at, pairs[:, 0] + 1, 1)
        np.cumsum(self.item_at, out=self.item_at)
        self.item_of = pairs[:, 1].astype(np.int32)
        self.names = np.array(names, np.int64)
        for item, c in coded:
            flat.setdefault(number[item], []).extend([-1, *c] if number[item] in flat else c)
        self.text_of = [np.array(flat[i], np.int32) for i in range(len(names))]

    # reading

    def _follow(self, state: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The state after each (state, word), -1 where there is none."""
        key = (state << self.bits) | w
        at = _slot(state, w) & self.mask
        out = np.full(len(state), -1, np.int64)
        todo = np.arange(len(state))
        while len(todo):
            found = self.key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def stream(self, lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lane, index of the last word, length of the longest match, state) wherever that length is at least `least`, all lanes in step.

        A lane of known words is cut into pieces that overlap by least - 1 words, so a length is right up to PIECE words.
        """
        step = PIECE
        pieces = [(i, a) for i, lane in enumerate(lanes) for a in range(0, max(1, len(lane) - self.least + 1), step)]
        sizes = np.array([min(step + self.least - 1, len(lanes[i]) - a) for i, a in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes, lane = sizes[order], np.array([p[0] for p in pieces], np.int64)[order]
        start = np.array([p[1] for p in pieces], np.int64)[order]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in lanes])]).astype(np.int64)
        flat = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
        begin = offset[lane] + start
        state, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        out = []
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t))  # pieces with more than t words come first
            w = flat[begin[:live] + t]
            s, k = state[:live], n[:live]
            to = self._follow(s, w)
            k += 1
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                back = self.link[s[stuck]].astype(np.int64)
                gone = back < 0
                s[stuck], k[stuck] = np.where(gone, 0, back), np.where(gone, 0, self.len[back] + 1)
                to[stuck[gone]] = 0
                stuck = stuck[~gone]
                to[stuck] = self._follow(s[stuck], w[stuck])
                stuck = stuck[to[stuck] < 0]
            state[:live] = to
            hit = np.flatnonzero(k >= self.least)
            if len(hit):
                out.append((lane[hit], start[hit] + t, k[hit].copy(), to[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*out))

    def found(self, texts: list[list[str]]) -> list[list[tuple[int, int, np.ndarray]]]:
        """Per text (index of the last word, length of the longest match, item numbers), in order; only stretches of known words are streamed, as no other can hold a match."""
        lanes, whose, where = [], [], []
        for i, ws in enumerate(texts):
            if len(ws) < self.least:
                continue
            ids = np.fromiter((self.ids.get(w, -1) for w in ws), np.int64, len(ws))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= self.least:
                    lanes.append(ids[a:b])
                    whose.append(i)
                    where.append(a)
        out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in texts]
        lane, at, n, state = self.stream(lanes)
        for j in np.lexsort((at, lane)).tolist():
            i, s = lane[j], self.named[state[j]]
            out[whose[i]].append((where[i] + int(at[j]), int(n[j]), self.item_of[self.item_at[s] : self.item_at[s + 1]]))
        return out

    def longest_runs(self, ws: list[str], found: list[tuple[int, int, np.ndarray]]) -> dict[int, int]:
        """item number -> words of its longest run in the text."""
        places: dict[int, list[int]] = {}
        for at, _, items in found:
            for item in items.tolist():
                places.setdefault(item, []).append(at)
        ids = np.fromiter((self.ids.get(w, -2) for w in ws), np.int64, len(ws))
        out = {}
        for item, ends in places.items():
            text, best = self.text_of[item], 0
            cuts = np.flatnonzero(np.diff(ends) > 1) + 1
            for run in np.split(np.array(ends), cuts):
                reach = np.zeros(len(text) + 1, np.int64)
                for w in ids[run[0] - self.least + 1 : run[-1] + 1].tolist():
                    reach[1:] = np.where(text == w, reach[:-1] + 1, 0)
                    best = max(best, int(reach.max()))
            out[item] = best
        return out


def automata(items: DataFrame, least: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """The items in automata of at most block_words words (or one longer item)."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        ws = words(r[1])
        if len(ws) < least:
            continue
        if size and size + len(ws) > block_words and block[-1][0] != r[0]:
            yield SuffixAutomaton(block, least)
            block, size = [], 0
        block.append((r[0], ws))
        size += len(ws)
    if block:
        yield SuffixAutomaton(block, least)


def _scan(documents: DataFrame, items: DataFrame, least: int, block_words: int, rows_of, schema: str) -> DataFrame:
    """What rows_of(automaton, texts) yields as (index of the text, ...) for each automaton, with the document's id in place of the index."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])
    result = None
    for automaton in automata(items, least, block_words):
        sent = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[i], *rest) for i, *rest in rows_of(sent.value, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

        part = texts.mapInArrow(run, schema)
        result = part if result is None else result.union(part)
    return spark.createDataFrame([], schema) if result is None else result


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_words: the longest run of the item's words in the document, where it is at least `least`."""

    def rows_of(automaton: SuffixAutomaton, texts: list[str]) -> Iterator[tuple]:
        cut = [words(t) for t in texts]
        for i, found in enumerate(automaton.found(cut)):
            if found:
                yield from ((i, int(automaton.names[item]), n) for item, n in automaton.longest_runs(cut[i], found).items())

    rows = _scan(documents, items, least, block_words, rows_of, "doc_id bigint, item_id bigint, n_words int")
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def leak_report(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """Per item with a leak: item_id, sett, n_documents, longest."""
    found = leaked_items(documents, items, least)
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))
    return per.join(items.select(F.col("item_id").cast("bigint").alias("item_id"), "sett").distinct(), "item_id")


def leaking_spans(documents: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK) -> DataFrame:
    """doc_id, first, last: character positions [first, last) of stretches that hold only words of item passages."""

    def rows_of(automaton: SuffixAutomaton, texts: list[str]) -> Iterator[tuple]:
        cut = [words(t) for t in texts]
        for i, found in enumerate(automaton.found(cut)):
            if not found:
                continue
            placed = placed_words(texts[i])
            start, end = found[0][0] - found[0][1] + 1, found[0][0]
            for at, n, _ in found[1:]:
                if at - n + 1 > end + 1:
                    yield i, placed[start][1], placed[end][2]
                    start = at - n + 1
                start, end = min(start, at - n + 1), at
            yield i, placed[start][1], placed[end][2]

    return _scan(documents, items, least, block_words, rows_of, "doc_id bigint, first int, last int")


def without_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, most_part: float = 0.5, block_words: int = BLOCK) -> DataFrame:
    """Each document with a leak, once: doc_id, n_spans, cut_chars, text without the leaking spans.

    text is null, the whole document to be dropped, where the spans cover more than
    most_part of its characters. An id with several texts has a row for each of them.
    """
    key = F.xxhash64("doc_id", "text")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    spans = materialize(leaking_spans(texts.select(key.alias("doc_id"), "text"), items, least, block_words))
    held = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, spans in zip(f["doc_id"], f["text"], f["spans"]):
                merged: list[list[int]] = []
                for s in sorted((s["first"], s["last"]) for s in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                gone = sum(e - s for s, e in merged)
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((doc, len(merged), gone, None if gone > most_part * len(text) else kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_spans", "cut_chars", "text"])

    leaky = texts.withColumn("key", key).join(held, "key").dropDuplicates(["key"])
    return leaky.select("doc_id", "text", "spans").mapInPandas(cut, "doc_id bigint, n_spans int, cut_chars int, text string")
