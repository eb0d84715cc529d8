"""Runs (maximal repetitions) of words, found on a grammar of each text.

1. Words become numbers that are exact within a text. A run of 12 words or more, of period q and at
   least twice as long, is covered by six-word windows that recur in it; so words outside all
   windows that recur in their text are cut out first and what is left falls into stretches.
   A hash finds the windows; that two of them share one only leaves more to do.
2. Re-Pair replaces a most frequent pair of neighbours of a text by a new symbol, again and again
   until no pair is left twice. Pairs that are equally frequent and share no symbol are replaced at
   once, which is one order of the ties, and the texts of a batch advance together.
3. A run of a stretch lies across the border of the two halves of exactly one node of the derivation,
   the lowest that holds it whole. The runs across the border of each symbol are computed once, by
   the longest common extensions to both sides.
4. They are translated to every place where the symbol stands; places of one period that overlap by
   a period are merged, and each interval keeps its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import table, whole_text

MIN_WORDS = 12
#: A run of so many words is covered by recurring windows of half its length.
WINDOW_WORDS = MIN_WORDS // 2
#: Words of one batch that is worked on together; a longer text is a batch of its own.
BATCH_WORDS = 400_000

Run = tuple[int, int, int]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, which is what bytes split at."""
    return text.encode("utf-8", "surrogatepass").split()


def recurring(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word lies in a six-word window that recurs in its text."""
    n = len(ids) - WINDOW_WORDS + 1
    if n <= 1:
        return np.zeros(len(ids), bool)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = text[:n].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(WINDOW_WORDS):
        key = (key ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    starts = np.flatnonzero(text[:n] == text[WINDOW_WORDS - 1 :])
    key = key[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts[twice], 1)
    np.add.at(edges, starts[twice] + WINDOW_WORDS, -1)
    return np.cumsum(edges[:-1]) > 0


def repair(symbols: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Re-Pair of many texts at once: what is left of each stretch, where stretches end, and the pairs.

    ``symbols`` are numbers from 0, no two texts share one; ``ends`` marks the last word of a stretch;
    the pair at index k is the rule of symbol (number of terminals + k).
    """
    rules: list[tuple[int, int]] = []
    terminals = int(symbols.max()) + 1 if len(symbols) else 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(symbols))
    while len(symbols):
        left = np.flatnonzero(~ends[:-1])
        alike = symbols[left] == symbols[left + 1]
        if alike.any():
            # Of "aaaa" the pairs at even places count, the others overlap them.
            where = left[alike]
            fresh = np.ones(len(where), bool)
            fresh[1:] = np.diff(where) > 1
            first = where[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            keep = np.ones(len(left), bool)
            keep[np.flatnonzero(alike)[(where - first) % 2 == 1]] = False
            left = left[keep]
        pairs = symbols[left].astype(np.int64) << 32 | symbols[left + 1]
        distinct, first, which, counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        owner = text[left[first]] if len(left) else np.empty(0, np.int64)
        most = np.zeros(int(text.max()) + 1, np.int64)
        np.maximum.at(most, owner, counts)
        # Texts without a pair that occurs twice are ready.
        ready = most[text] < 2
        if ready.any():
            done.append((at[ready], symbols[ready], ends[ready]))
            if ready.all():
                break
        chosen = np.flatnonzero((counts == most[owner]) & (counts > 1))
        one, two = distinct[chosen] >> 32, distinct[chosen] & 0xFFFFFFFF
        rank = np.random.default_rng(len(rules)).permutation(len(chosen)) + 1
        names, local = np.unique(np.concatenate([one, two]), return_inverse=True)
        top = np.zeros(len(names), np.int64)
        np.maximum.at(top, local, np.concatenate([rank, rank]))
        wins = (top[local[: len(chosen)]] == rank) & (top[local[len(chosen) :]] == rank)
        new = np.full(len(distinct), -1, np.int64)
        new[chosen[wins]] = terminals + len(rules) + np.arange(wins.sum())
        rules += zip(one[wins].tolist(), two[wins].tolist(), strict=True)
        hit = left[new[which] >= 0]
        symbols, ends = symbols.copy(), ends.copy()
        symbols[hit] = new[which][new[which] >= 0]
        ends[hit] = ends[hit + 1]
        stays = ~ready
        stays[hit + 1] = False
        symbols, text, ends, at = symbols[stays], text[stays], ends[stays], at[stays]
    if not done:
        return symbols, ends, rules
    order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
    return np.concatenate([d[1] for d in done])[order], np.concatenate([d[2] for d in done])[order], rules


def common_prefixes(word: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of the word and its rest."""
    n = len(word)
    found = [n] + [0] * (n - 1)
    low = high = 0
    for i in range(1, n):
        size = min(found[i - low], high - i) if i < high else 0
        while i + size < n and word[size] == word[i + size]:
            size += 1
        if i + size > high:
            low, high = i, i + size
        found[i] = size
    return found


def across(left: list[int], right: list[int], least: int) -> set[Run]:
    """Repetitions (start, end, period) of ``left + right`` that reach across the border, are as long
    as ``least`` and twice their period, and go on to neither side within the two."""
    a, b = len(left), len(right)
    found: set[Run] = set()
    back = left[::-1]
    ends = common_prefixes(back)
    starts = common_prefixes(right)
    onward = common_prefixes([*right, -1, *left])[b + 1 :]
    rearward = common_prefixes([*back, -1, *right[::-1]])[a + 1 :]
    for q in range(1, a + 1):
        # The border is at the end of a period that lies on the left.
        before = ends[q] if q < a else 0
        after = onward[a - q]
        if after == q:
            after += _more(right, starts, q)
        if before + after >= q and q + before + after >= least:
            found.add((a - q - before, a + after, q))
    for q in range(1, b + 1):
        # The border is at the start of a period that lies on the right.
        after = starts[q] if q < b else 0
        before = rearward[b - q]
        if before == q:
            before += _more(back, ends, q)
        if before + after >= q and q + before + after >= least:
            found.add((a - before, a + q + after, q))
    return found


def _more(word: list[int], prefixes: list[int], q: int) -> int:
    """How far a repetition of period q that starts with the word's first q goes on after them."""
    return prefixes[q] if q < len(word) else 0


def merged(found: Iterator[Run] | Sequence[Run]) -> list[Run]:
    """Maximal runs: what overlaps by its period is one run, and each interval has its smallest period."""
    joined: list[list[int]] = []
    for start, end, q in sorted(found, key=lambda r: (r[2], r[0], -r[1])):
        if joined and joined[-1][2] == q and start <= joined[-1][1] - q:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end, q])
    best: dict[tuple[int, int], int] = {}
    for start, end, q in joined:
        best[start, end] = min(q, best.get((start, end), q))
    return sorted((start, end, q) for (start, end), q in best.items())


class Grammar:
    """Rules of a batch, the expansion of each symbol and the runs across its border."""

    def __init__(self, terminals: int, rules: list[tuple[int, int]], least: int) -> None:
        self.terminals, self.rules, self.least = terminals, rules, least
        self.sizes = [1] * terminals
        for one, two in rules:
            self.sizes.append(self.sizes[one] + self.sizes[two])
        self.crossing: dict[int, set[Run]] = {}
        self.holds: dict[int, bool] = {}

    def expanded(self, symbol: int) -> list[int]:
        out, waiting = [], [symbol]
        while waiting:
            top = waiting.pop()
            if top < self.terminals:
                out.append(top)
            else:
                one, two = self.rules[top - self.terminals]
                waiting += (two, one)
        return out

    def folded(self, sequence: list[int]) -> int:
        """One symbol for a sequence, by halves of about the same length."""
        while len(sequence) > 1:
            above = []
            for i in range(0, len(sequence) - 1, 2):
                self.rules.append((sequence[i], sequence[i + 1]))
                self.sizes.append(self.sizes[sequence[i]] + self.sizes[sequence[i + 1]])
                above.append(self.terminals + len(self.rules) - 1)
            sequence = above + sequence[len(sequence) & ~1 :]
        return sequence[0]

    def resolve(self, symbol: int) -> None:
        """Runs across the borders of a symbol and all below it, each symbol once."""
        waiting = [symbol]
        while waiting:
            top = waiting[-1]
            if top in self.holds:
                waiting.pop()
                continue
            if self.sizes[top] < self.least:
                self.holds[top] = False
                continue
            one, two = self.rules[top - self.terminals]
            open_ = [s for s in (one, two) if s not in self.holds]
            if open_:
                waiting += open_
                continue
            self.crossing[top] = across(self.expanded(one), self.expanded(two), self.least)
            self.holds[top] = bool(self.crossing[top]) or self.holds[one] or self.holds[two]

    def translated(self, symbol: int, start: int) -> Iterator[Run]:
        """The runs of every symbol below, at every place where it stands."""
        waiting = [(symbol, start)]
        while waiting:
            top, at = waiting.pop()
            if not self.holds[top]:
                continue
            yield from ((at + s, at + e, q) for s, e, q in self.crossing[top])
            one, two = self.rules[top - self.terminals]
            waiting += ((one, at), (two, at + self.sizes[one]))


def runs_of(texts: Sequence[Sequence[bytes]], least: int = MIN_WORDS) -> list[list[Run]]:
    """Maximal runs (start, end, period) of each text's words, by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    found: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    text = np.repeat(np.arange(len(texts)), sizes)
    words = np.empty(len(text), object)
    words[:] = [w for t in texts for w in t]
    ids, _ = pd.factorize(words)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    live = np.flatnonzero(recurring(ids, text))
    if not len(live):
        return found
    ends = np.ones(len(live), bool)
    ends[:-1] = (np.diff(live) > 1) | (text[live[1:]] != text[live[:-1]])
    first = live[np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])]
    symbols, _ = pd.factorize(text[live] * (int(ids.max()) + 1) + ids[live])
    left, stops, rules = repair(symbols.astype(np.int64), text[live], ends)
    grammar = Grammar(int(symbols.max()) + 1, rules, least)
    parts: list[list[Run]] = [[] for _ in texts]
    begin = 0
    for start, stop in zip(first.tolist(), (np.flatnonzero(stops) + 1).tolist(), strict=True):
        top = grammar.folded(left[begin:stop].tolist())
        begin = stop
        grammar.resolve(top)
        parts[text[start]] += grammar.translated(top, int(place[start]))
    return [merged(p) if p else [] for p in parts]


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return list(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, end, q in runs:
        edges[start + q] += 1
        edges[end] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _batches(batch: pd.DataFrame, planted: bool) -> Iterator[tuple[list[object], list[list[bytes]]]]:
    keys: list[object] = []
    texts: list[list[bytes]] = []
    size = 0
    for key, text in zip(batch["key"], batch["body"], strict=True):
        words = words_of(text)
        if planted:
            words = with_period(key, words)
        if texts and size + len(words) > BATCH_WORDS:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(words)
        size += len(words)
    if texts:
        yield keys, texts


def with_period(key: str | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted period: from word a on, of every tenth document by its key's CRC."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def _reported(planted: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def reported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, texts in _batches(batch, planted):
                rows = []
                for words, runs in zip(texts, runs_of(texts), strict=True):
                    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
                    kept = b" ".join(collapsed(words, runs))
                    rows.append((lines, kept))
                found = pd.DataFrame(rows, columns=["lines", "kept"])
                yield found.assign(key=keys, kept=[k.decode("utf-8", "surrogatepass") for k in found["kept"]])[["key", "lines", "kept"]]

    return reported


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", planted: bool = False) -> DataFrame:
    """Rows (key, runs, collapsed) for every row of ``docs``: its maximal runs of words as an array of
    (start, length, period) by start and period, and its words without what repeats.

    A run is a stretch of words, at least 12 and twice its smallest period, that goes on to neither
    side. Words are counted from 0. Null text counts as empty; without runs the array is empty and
    the words are joined by single spaces. Repeated rows each give their row. Other columns are not
    read. A text is worked on as a whole by one task. ``planted`` puts the contract's periods in.
    """
    given = docs.select(F.col(key).cast("string").alias("key"), whole_text(text).alias("body"))
    found = given.mapInPandas(_reported(planted), "key string, lines string, kept string")
    lines = F.filter(F.split("lines", "\n"), lambda x: x != "")
    run = lambda x: F.struct(
        *[F.split(x, ",")[i].cast("long").alias(c) for i, c in enumerate(("start", "length", "period"))]
    )
    kind = docs.schema[key].dataType
    return found.select(F.col("key").cast(kind).alias(key), F.transform(lines, run).alias("runs"), F.col("kept").alias("collapsed"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_runs(table(spark, sf_dir, "documents"), planted=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(F.array_join(line, "\n"), F.lit("\n")))
    found = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    length, period = -F.col("top.less"), F.col("top.period")
    return found.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", length * 1000, period).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
