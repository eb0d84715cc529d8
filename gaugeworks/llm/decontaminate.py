"""Benchmark decontamination: rare word n-grams lead to test items, alignment scores the passages.

An item of L words counts as leaked where the best local alignment (Smith-Waterman over words:
match 1, mismatch and gap -1) of a passage reaches 0.8 L. Such a passage can spoil at most two
3-grams of the item for each point it loses, so at least a known number of the item's 3-grams are
intact in it; by the pigeonhole rule, one of the item's rarest 3-grams is. Rarity is counted over
all documents. Only documents with one of these seeds look closer, only around places where enough
3-grams meet, and only there an alignment is computed. No leak above the threshold is lost.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import table, whole_text

GRAM_WORDS = 3
SIMILARITY = 0.8
#: Shorter items leak only as a whole, word for word; an edited one is not told from ordinary language.
MIN_ITEM_WORDS = 8
#: Items held by a task at a time; more are looked for in further rounds over the same rows.
ITEMS_PER_ROUND = 5_000
#: Words of a text looked at together; consecutive stretches overlap by two item lengths.
STRETCH_WORDS = 200_000

_WORD = re.compile(r"\w+")
_FIELDS = ("item_id", "score", "first_word", "last_word")
_LEAKS = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(GRAM_WORDS)), strict=False)


@dataclass(frozen=True)
class Items:
    """Benchmark items of one round, as words, with their distinct grams numbered; short items apart."""

    ids: tuple[int | None, ...]
    words: tuple[tuple[str, ...], ...]
    grams: dict[tuple[str, ...], int]
    short: tuple[tuple[int | None, tuple[str, ...]], ...] = ()

    def own_grams(self, item: int) -> set[int]:
        return {self.grams[g] for g in grams_of(list(self.words[item]))}


def spoiled(length: int) -> int:
    """How many grams of an item a passage over the threshold can spoil at most."""
    return int((1 - SIMILARITY) * length * 2 + 1e-9)


def needed(items: Items, item: int) -> int:
    return max(1, len(items.own_grams(item)) - spoiled(len(items.words[item])))


def load_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[Items]:
    """Items in rounds of bounded size. Items without words are left out; equal items stay, each
    under its own key."""
    rounds = []
    rows = benchmark.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")).orderBy("key", "text")
    found = ((r["key"], tuple(words_of(r["text"]))) for r in rows.toLocalIterator())
    found = (item for item in found if item[1])
    while whole := list(islice(found, ITEMS_PER_ROUND)):
        part = [item for item in whole if len(item[1]) >= MIN_ITEM_WORDS]
        short = tuple(item for item in whole if len(item[1]) < MIN_ITEM_WORDS)
        grams: dict[tuple[str, ...], int] = {}
        for _, words in part:
            for gram in grams_of(list(words)):
                grams.setdefault(gram, len(grams))
        rounds.append(Items(tuple(k for k, _ in part), tuple(w for _, w in part), grams, short))
    return rounds


def gram_frequency(docs: DataFrame, items: Items, text: str = "text") -> dict[int, int]:
    """In how many documents each gram of the items occurs: one row per gram comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(items.grams)

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        grams = shared.value
        known = grams.__contains__
        return pd.Series([[grams[g] for g in set(filter(known, grams_of(words_of(t))))] for t in texts], dtype=object)

    found = docs.select(F.explode(present(whole_text(text))).alias("gram")).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in found.collect()}


def rare_seeds(items: Items, frequency: dict[int, int]) -> dict[tuple[str, ...], list[int]]:
    """The rarest grams of each item, as many as make sure that a leaked passage has one of them."""
    seeds = set()
    owners: dict[int, list[int]] = defaultdict(list)
    for item in range(len(items.ids)):
        own = sorted(items.own_grams(item), key=lambda g: (frequency.get(g, 0), g))
        for gram in own[: len(own) - needed(items, item) + 1]:
            seeds.add(gram)
            owners[gram].append(item)
    return {gram: owners[number] for gram, number in items.grams.items() if number in seeds}


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and first and last position in the passage."""
    width = len(passage)
    ahead = np.arange(width + 1)
    score = np.zeros(width + 1, np.int64)
    start = ahead.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, 1, -1)
        up = score[1:] - 1
        new = np.maximum(0, np.maximum(diagonal, up))
        begun = np.where(new == 0, ahead[1:], np.where(new == diagonal, start[:-1], start[1:]))
        new = np.concatenate([[0], new])
        begun = np.concatenate([[0], begun])
        # Gaps along the row: the best earlier cell less one for each step.
        lifted = new + ahead
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, ahead, 0))
        score = np.maximum(0, top - ahead)
        start = np.where(score == 0, ahead, begun[source])
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at - 1)
    return best


class Matcher:
    """Looks for leaked items in texts."""

    def __init__(self, items: Items, seeds: dict[tuple[str, ...], list[int]]):
        self.items, self.seeds = items, seeds
        self.longest = max((len(w) for w in (*items.words, *(w for _, w in items.short))), default=0)
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, words) in enumerate(items.short):
            self.short[len(words)][words].append(number)
        self.needed = {i: needed(items, i) for i in {i for owners in seeds.values() for i in owners}}

    def _stretches(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Stretches of words, of which only one is held at a time."""
        found = (m[0] for m in _WORD.finditer(text.lower()))
        base, held = 0, list(islice(found, STRETCH_WORDS))
        while True:
            yield base, held
            more = list(islice(found, STRETCH_WORDS))
            if not more:
                return
            kept = held[-2 * self.longest :] if self.longest else []
            base += len(held) - len(kept)
            held = kept + more

    def _in_stretch(self, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
        owners = {i for gram in set(filter(self.seeds.__contains__, grams_of(words))) for i in self.seeds[gram]}
        if not owners:
            return
        wanted = {gram: number for i in owners for gram in grams_of(list(self.items.words[i])) for number in [self.items.grams[gram]]}
        hits = [(at, wanted[gram]) for at, gram in enumerate(grams_of(words)) if gram in wanted]
        at = np.array([h[0] for h in hits])
        gram = np.array([h[1] for h in hits])
        for item in sorted(owners):
            own = np.isin(gram, list(self.items.own_grams(item)))
            places, names = at[own], gram[own]
            length = len(self.items.words[item])
            # A passage over the threshold is at most this long, gaps included.
            reach = length + spoiled(length)
            ends = np.searchsorted(places, places + reach, side="right")
            dense = [k for k in range(len(places)) if ends[k] - k >= self.needed[item] and len(set(names[k : ends[k]])) >= self.needed[item]]
            until = -1
            for k in dense:
                if places[k] <= until:
                    continue
                # Neighbouring places are aligned together.
                last = ends[k] - 1
                for more in dense:
                    if more > k and places[more] <= places[last]:
                        last = max(last, ends[more] - 1)
                low, high = max(0, places[k] - reach), min(len(words), places[last] + GRAM_WORDS + reach)
                until = places[last]
                numbers = {w: n for n, w in enumerate(set(self.items.words[item]))}
                target = np.array([numbers[w] for w in self.items.words[item]])
                passage = np.array([numbers.get(w, -1) for w in words[low:high]])
                score, first, end = align(target, passage)
                if score >= SIMILARITY * length - 1e-9:
                    yield item, score, int(low + first), int(low + end)

    def _whole(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """Short items that occur word for word, with first and last word of each place."""
        for length, owners in self.short.items():
            for at, found in enumerate(zip(*(words[i:] for i in range(length)), strict=False)):
                if found in owners:
                    for item in owners[found]:
                        yield item, at, at + length - 1

    def leaks(self, text: str) -> list[tuple[int | None, float, int, int]]:
        """(item_id, score over item length, first and last word) of each leaked item, best place first found."""
        best: dict[int, tuple[int, int, int]] = {}
        whole: dict[int, tuple[int, int]] = {}
        for base, words in self._stretches(text):
            for item, score, first, last in self._in_stretch(words):
                if item not in best or score > best[item][0]:
                    best[item] = (score, base + first, base + last)
            for item, first, last in self._whole(words):
                whole.setdefault(item, (base + first, base + last))
        found = [
            (self.items.ids[i], score / len(self.items.words[i]), first, last) for i, (score, first, last) in sorted(best.items())
        ]
        return found + [(self.items.short[i][0], 1.0, first, last) for i, (first, last) in sorted(whole.items())]


def _finder(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(_LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield pd.Series([[dict(zip(_FIELDS, leak, strict=True)) for leak in matcher.leaks(t)] for t in texts], dtype=object)

    return find.asNondeterministic()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """Column with the leaked items of each text: item_id, score (0.8 to 1, of short items 1), first and last word.

    Words are lower-cased runs of letters, digits and underscores. Null and empty texts leak
    nothing, nor does anything without items; repeated rows are each judged. A null item_id stays.
    """
    found = [F.array().cast(_LEAKS)]
    for items in load_items(benchmark):
        seeds = rare_seeds(items, gram_frequency(docs, items, text))
        found.append(_finder(docs.sparkSession.sparkContext.broadcast((items, seeds)))(whole_text(text)))
    return F.concat(*found)


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item; nothing is shuffled and all columns stay."""
    return docs.withColumn("__leaks", leaks(docs, benchmark)).filter(F.size("__leaks") == 0).drop("__leaks")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that leaked into it."""
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", found.alias("leaks")).select("doc_id", F.inline("leaks"))
