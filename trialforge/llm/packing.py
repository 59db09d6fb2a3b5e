"""Best-fit packing of token sequences by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import scratch, table

#: Fixed by the contract.
CAPACITY, END_ID = 1024, 2
SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class Settings:
    """block: pieces that are packed together; islands: populations per block; epochs: times they evolve, elites
    moving to the next island between; generations: at most so many an epoch, which ends after `patience` of them
    without fewer bins; full: fill from which a bin is worth injecting, and below which a block's bins are packed once
    more with those of `merge` other blocks. first: (islands, epochs, generations) of the blocks before that. An input of
    any size goes through both, a single block too."""

    block: int = 6000
    islands: int = 3
    population: int = 6
    epochs: int = 4
    generations: int = 12
    patience: int = 3
    full: float = 0.985
    merge: int = 12
    first: tuple[int, int, int] = (2, 2, 2)
    seed: int = 5


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for the file.

    A byte-level BPE file whose ids are the merge ranks is run by tiktoken, which merges the same way five times as
    fast; the probe texts must agree, or the library itself is used. So it is for texts that hold a special token or a
    run of white space on which the fast engine, whose pattern looks back over it, could run out of stack, and for
    any other text on which that engine fails.
    """

    PROBES = (
        "Naïve  café's\n\n 12 ½ words—they'll\t🙂 merge   as before... " + "ab" * 80,
        "DON'T i'm we've you'd he'll it's 'quoted' ''s _under_score-dash/slash\\back #tag @at 3.14 1,000 0x1F",
        " lead\n trail \n\n\n   \t x\r\n nbsp em　wide line\u0085next \x00\x1f\x7f end  ",
        "नमस्ते दुनिया שלום עולם 你好，世界。 こんにちは 안녕하세요 สวัสดี Ⅷ ² ﬁ é 👩‍👩‍👧 ﻿�",
        "a" * 40 + " " + "0" * 20 + " " + "!" * 20 + " " * 300 + "z" + "\n" * 300,
    )
    #: White space in a row from which the library is asked; the fast engine stood 700,000 in trials.
    LONG_RUN = re.compile(r"\s{20000}")
    #: How a pattern may end, and the runs that this divides: a text without them is cut the same way by white space alone,
    #: for which the fast engine need not look ahead. Python's white space holds all of that engine's.
    AHEAD, DIVIDED = r"|\s+(?!\S)|\s+", re.compile(r"\s\s")

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.slow = path, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(_BYTES[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.removesuffix(self.AHEAD) + r"|\s+", mergeable_ranks=ranks, special_tokens={}) if pattern.endswith(self.AHEAD) else self.fast
        if any(self.engine(t).encode_ordinary(t) != self.slow.encode(t, add_special_tokens=False).ids for p in self.PROBES for t in (p, *p.split())) or any(self.fast.encode_ordinary(t) != self.slow.encode(t, add_special_tokens=False).ids for t in self.PROBES):
            self.fast = None
        else:
            self.slow = None  # it takes memory, and is loaded again for a text that needs it

    def library(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.slow = self.slow or Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def engine(self, text: str):
        return self.fast if self.plain is self.fast or self.DIVIDED.search(text) else self.plain

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END_ID], "<u4")
        if self.fast is None or SPECIAL in text or len(text) >= 20_000 and self.LONG_RUN.search(text):
            return np.array([*self.library(text), END_ID], "<u4")
        try:
            out = self.engine(text).encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # which is no Exception
                raise
            out = self.library(text)
        out.append(END_ID)
        return np.frombuffer(array("I", out), "<u4")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _byte_letters()
_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def default_tokenizer() -> tuple[str, str]:
    """Path of the vocabulary file and its word pattern, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def cut(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first one with the rest."""
    first = len(ids) if len(ids) <= CAPACITY else len(ids) % CAPACITY or CAPACITY
    return [(0, first)] + [(s, CAPACITY) for s in range(first, len(ids), CAPACITY)]


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces of each row of docs, in one pass over whole texts.

    The path is opened on the executors, where the tokenizer package is installed. Null text: empty, one piece [2].
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*(tokenizer or default_tokenizer()))
        for b in batches:
            for a in range(0, b.num_rows, 1000):  # so the ids of few texts are held at once
                part = b.slice(a, 1000)
                at, rows, ids = [], [], []
                for i, t in enumerate(part.column("text")):
                    x = enc.ids(t.as_py())
                    for k, (s, n) in enumerate(cut(x)):
                        at.append(i)
                        rows.append((k, s, n, zlib.crc32(x[s : s + n].tobytes())))
                        if with_ids:
                            ids.append(x[s : s + n].astype(np.int32))
                cols = [part.column("doc_id").take(pa.array(at))] + [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Packing:
    """Bins of items, with each bin's free room and the bins of each free room at hand for best fit.

    Packings share bins, so a bin is replaced and never changed in place. room: that of each bin, where it is known.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]] = (), room: list[int] | None = None):
        self.sizes, self.bins = sizes, list(bins)
        self.room = [CAPACITY - sum(sizes[i] for i in b) for b in bins] if room is None else list(room)
        self.by_room: dict[int, set[int]] = {}
        self.mask = 0  # bit r: some bin has r left
        for k, r in enumerate(self.room):
            if r:
                self._file(k, r)

    def _set(self, k: int, items: list[int], room: int) -> None:
        """Bin k, or the next one, gets these items."""
        if k == len(self.bins):
            self.bins.append(items)
            self.room.append(room)
        else:
            self._unfile(k)
            self.bins[k], self.room[k] = items, room
        if room:
            self._file(k, room)

    def _file(self, k: int, r: int) -> None:
        self.by_room.setdefault(r, set()).add(k)
        self.mask |= 1 << r

    def _unfile(self, k: int) -> None:
        r = self.room[k]
        self.by_room[r].discard(k)
        if not self.by_room[r]:
            self.mask ^= 1 << r

    def best_fit(self, items: list[int]) -> "Packing":
        """Put each item, largest first, where the least room stays; open a bin where none has room."""
        for i in sorted(sorted(items), key=self.sizes.__getitem__, reverse=True):
            s = self.sizes[i]
            left = self.mask >> s
            if not left:
                self._set(len(self.bins), [i], CAPACITY - s)
                continue
            r = s + (left & -left).bit_length() - 1
            k = next(iter(self.by_room[r]))
            self._set(k, [*self.bins[k], i], r - s)
        return self

    def exchange(self, free: list[int], rng: np.random.Generator, most: int = 400) -> list[int]:
        """The bins of most room give up to two items for one or two of the free ones that leave less room, the least
        there is; what is free then is returned. It is never more size than before, in smaller items."""
        size, room = self.sizes.__getitem__, np.array(self.room)
        free = sorted(free, key=size)
        emptiest, offers = np.argsort(-room, kind="stable")[:most], None
        for k in rng.permutation(emptiest[room[emptiest] > 0]).tolist():
            if not free:
                break
            items, left = self.bins[k], self.room[k]
            few = items if len(items) <= 6 else [items[x] for x in rng.permutation(len(items))[:6]]
            outs, weights = _couples([size(i) for i in few])
            if offers is None:
                offers = self._offers(free)
            ins, totals = offers
            best = np.searchsorted(totals, weights + np.int16(left), "right") - 1
            gains = totals[best] - weights
            x = int(gains.argmax())
            if gains[x] <= 0:
                continue
            given = [few[j] for j in outs[:, x].tolist() if j >= 0]
            taken = sorted((j for j in ins[:, best[x]].tolist() if j >= 0), reverse=True)
            self._set(k, [i for i in items if i not in given] + [free[j] for j in taken], left - int(gains[x]))
            for j in taken:
                del free[j]
            for i in given:
                insort(free, i, key=size)
            offers = None
        return free

    def _offers(self, free: list[int], most: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places in free (-1: none) and their sums, ascending; of a long list, evenly spaced places."""
        n = len(free)
        at = np.arange(n) if n <= most else np.arange(most) * (n - 1) // (most - 1)
        pairs, totals = _couples([self.sizes[free[j]] for j in at.tolist()])
        order = np.argsort(totals, kind="stable")
        return np.append(at, -1)[pairs[:, order]], totals[order]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the sum of squared fills."""
        return -len(self.bins), float(((CAPACITY - np.array(self.room)) ** 2).sum()) / CAPACITY**2


@lru_cache(maxsize=128)
def _places(n: int) -> np.ndarray:
    """Up to two of n places, -1 where there is none: none, each one, each two, as columns."""
    a, b = np.triu_indices(n, 1)
    one, none = np.arange(n), np.full(n, -1)
    return np.stack([np.concatenate([[-1], one, a]), np.concatenate([[-1], none, b])])


def _couples(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of _places and their sums, in 16 bits: twice the capacity fits, and such are sorted in linear time."""
    pairs, values = _places(len(sizes)), np.array([*sizes, 0], np.int16)
    return pairs, values[pairs[0]] + values[pairs[1]]


def _of(sizes: list[int], bins: list[tuple[list[int], int]]) -> Packing:
    """A packing of bins and their room."""
    return Packing(sizes, [b for b, _ in bins], [r for _, r in bins])


def _settled(p: Packing, displaced: list[int], rng: np.random.Generator) -> Packing:
    """Displaced items trade places with those of bins that have room, then best fit places what is left."""
    return p.best_fit(p.exchange(displaced, rng))


def crossover(one: Packing, other: Packing, rng: np.random.Generator, full: float) -> Packing:
    """Some well-filled bins of other go whole into one; bins of one that hold the same items are dissolved, and the
    items that thereby lost their place are fitted in again."""
    every = list(zip(other.bins, other.room))
    good = [(b, r) for b, r in every if CAPACITY - r >= full * CAPACITY] or every
    share = rng.uniform(0.2, 0.7)
    injected = [b for b, x in zip(good, rng.random(len(good)).tolist()) if x < share]
    taken = {i for b, _ in injected for i in b}
    kept, displaced = [], []
    for b, r in zip(one.bins, one.room):
        if taken.isdisjoint(b):
            kept.append((b, r))
        else:
            displaced += [i for i in b if i not in taken]
    return _settled(_of(one.sizes, kept + injected), displaced, rng)


def mutate(p: Packing, rng: np.random.Generator) -> Packing:
    """Dissolve the emptiest bins and a few others, at most 40 in all, and settle their items anew."""
    n = min(len(p.bins), int(rng.integers(3, 12)))
    empty = np.argsort(-np.array(p.room), kind="stable")[:n]
    loose = {*empty.tolist(), *rng.choice(len(p.bins), min(len(p.bins), 28, max(1, len(p.bins) // 20)), replace=False).tolist()}
    kept = [x for k, x in enumerate(zip(p.bins, p.room)) if k not in loose]
    return _settled(_of(p.sizes, kept), [i for k in loose for i in p.bins[k]], rng)


def _noisy(sizes: list[int], rng: np.random.Generator) -> Packing:
    """A start: a random tenth of the items placed later than best fit would."""
    late = rng.random(len(sizes)) < 0.1
    p = Packing(sizes).best_fit([i for i in range(len(sizes)) if not late[i]])
    return p.best_fit([i for i in range(len(sizes)) if late[i]])


def least_bins(sizes: list[int]) -> int:
    """No packing has fewer bins: for each k, items over CAPACITY - k are alone, those over half are in bins of their own,
    and items from k up to half that don't fit beside these fill more."""
    counts = np.bincount(sizes, minlength=CAPACITY + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(CAPACITY + 1))
    half, k = CAPACITY // 2, np.arange(CAPACITY // 2 + 1)
    beside, under = CAPACITY * (n[CAPACITY - k] - n[half]) - (total[CAPACITY - k] - total[half]), np.maximum(k - 1, 0)
    more = np.maximum(0, -(-(total[half] - total[under] - beside) // CAPACITY))
    return int((n[CAPACITY] - n[half] + more).max())


def evolve(sizes: list[int], guests: list[list[int]], s: Settings, seed: int) -> Packing:
    """One island's turn: from best fit, noisy starts and the guests (bin of each item) to its best packing.

    Each generation, pairs of the fitter half have a child by crossover, and the fittest and a random other one by
    mutation; the fittest of parents and children live on. Ends early where no packing has fewer bins.
    """
    rng = np.random.default_rng(seed)
    least = least_bins(sizes)
    people = [_from_labels(sizes, g) for g in guests] or [Packing(sizes).best_fit(list(range(len(sizes))))]
    if max(len(p.bins) for p in people[:1]) == least:
        return people[0]
    while len(people) < s.population:
        people.append(_noisy(sizes, rng))
    people.sort(key=Packing.fitness, reverse=True)
    few, since = len(people[0].bins), 0
    for _ in range(s.generations):
        if few == least or since == s.patience:
            break
        young = [mutate(people[0], rng), mutate(people[int(rng.integers(len(people)))], rng)]
        for _ in range(max(1, s.population // 2)):
            a, b = sorted(rng.choice(max(2, (len(people) + 1) // 2), 2, replace=False))
            young.append(crossover(people[a], people[b], rng, s.full))
        people = sorted(people + young, key=Packing.fitness, reverse=True)[: s.population]
        since = since + 1 if len(people[0].bins) == few else 0
        few = len(people[0].bins)
    return people[0]


def _from_labels(sizes: list[int], labels: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(labels):
        bins.setdefault(b, []).append(i)
    return Packing(sizes, list(bins.values()))


def _labels(p: Packing) -> list[int]:
    out = [0] * len(p.sizes)
    for k, b in enumerate(p.bins):
        for i in b:
            out[i] = k
    return out


EVOLVED = "block long, island int, labels array<int>, bins int, least int, fill double"


def _epoch(islands: DataFrame, s: Settings, epoch: int) -> DataFrame:
    """Each row (block, island, sizes, guests) evolves in a task of its own."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for block, island, sizes, guests in zip(p["block"], p["island"], p["sizes"], p["guests"]):
                best = evolve([int(x) for x in sizes], [g.tolist() for g in guests], s, [s.seed, block, island, epoch])
                bins, fill = best.fitness()
                yield pd.DataFrame({"block": [block], "island": [island], "labels": [_labels(best)], "bins": [-bins], "least": [least_bins([int(x) for x in sizes])], "fill": [fill]})

    ship(islands.sparkSession)
    return islands.mapInPandas(work, EVOLVED)


def _solve(blocks: DataFrame, s: Settings) -> DataFrame:
    """block, sizes to block, labels: the best packing over all islands and epochs.

    The rows are few and small but slow, so they are dealt to a set number of tasks, which the planner won't merge.
    """
    tasks = min(10_000, max(1, blocks.count() * s.islands))
    islands = F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island")
    none = F.array().cast("array<array<int>>")
    found = None
    for epoch in range(s.epochs):
        if found is None:
            rows = blocks.select("block", "sizes", islands).withColumn("guests", none)
        else:  # each island goes on with its own elite and that of the island before it
            elites = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("island", "labels"))).alias("elites"))
            rows = blocks.join(elites, "block").select("block", "sizes", "elites", islands)
            own, left = F.col("island") + 1, (F.col("island") + s.islands - 1) % s.islands + 1
            rows = rows.select("block", "sizes", "island", F.array_distinct(F.array(F.element_at("elites", own)["labels"], F.element_at("elites", left)["labels"])).alias("guests"))
        found = scratch(_epoch(rows.repartition(tasks, F.col("block"), F.col("island")), s, epoch))
        if not found.groupBy("block").agg(F.min("bins").alias("bins"), F.max("least").alias("least")).filter("bins > least").head(1):
            break
    best = found.groupBy("block").agg(F.max(F.struct((-F.col("bins")).alias("few"), "fill", (-F.col("island")).alias("i"), "labels")).alias("best"))
    return best.select("block", "best.labels")


def pack(pieces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The columns of pieces, and sequence_id and offset: pieces of up to CAPACITY tokens in as few sequences as found.

    Full pieces are sequences of their own. The rest are dealt at random into blocks of about s.block, each packed by
    evolve() on s.islands islands; what a block leaves in bins that aren't well filled is packed again with the same
    of s.merge other blocks. No task gets more than some blocks, at any size of the input. Repeated rows are packed
    one by one. Columns sequence_id and offset are replaced. Empty table: empty result. Lengths must be from 1 to CAPACITY.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    fixed = scratch(pieces.withColumn("__row", F.monotonically_increasing_id()))
    rest = fixed.filter(F.col("length") < CAPACITY).select("__row", F.col("length").cast("int").alias("__size"))
    n = max(1, round(rest.count() / s.block))

    def pass_over(items: DataFrame, block, s: Settings) -> DataFrame:
        """__row, block, bin, at (place in the bin), fill of the bin."""
        dealt = items.withColumn("block", block.cast("long"))
        blocks = scratch(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct((-F.col("__size")).alias("s"), F.col("__row").alias("r")))).alias("items")).select("block", F.transform("items", lambda x: -x["s"]).alias("sizes"), F.transform("items", lambda x: x["r"]).alias("rows")))
        solved = blocks.join(_solve(blocks.select("block", "sizes"), s), "block")
        return solved.select("block", F.explode(F.arrays_zip("rows", "sizes", "labels")).alias("x")).select("block", F.col("x.rows").alias("__row"), F.col("x.sizes").alias("__size"), F.col("x.labels").alias("bin"))

    islands, epochs, generations = s.first
    before = replace(s, islands=islands, epochs=epochs, generations=generations)
    first = pass_over(rest, F.pmod(F.xxhash64("__row"), F.lit(n)), before)
    fill = first.groupBy("block", "bin").agg(F.sum("__size").alias("fill"))
    first = scratch(first.join(fill, ["block", "bin"]))
    loose = F.col("fill") < F.lit(int(s.full * CAPACITY))
    again = pass_over(first.filter(loose).select("__row", "__size", "block"), F.floor(F.col("block") / s.merge), s)
    placed = first.filter(~loose).select("__row", "__size", "block", "bin").unionByName(again.withColumn("block", -1 - F.col("block")))
    alone = fixed.filter(F.col("length") >= CAPACITY).select("__row", F.col("length").cast("int").alias("__size"), F.lit(None).cast("long").alias("block"), F.lit(0).alias("bin"))
    bins = placed.groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct(F.col("__row").alias("r"), F.col("__size").alias("s")))).alias("in_bin"))
    at = F.aggregate("in_bin", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<r:bigint,o:bigint>>").alias("out")), lambda acc, x: F.struct((acc["n"] + x["s"]).alias("n"), F.concat(acc["out"], F.array(F.struct(x["r"].alias("r"), acc["n"].alias("o")))).alias("out")), lambda acc: acc["out"])
    seats = bins.select((F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.explode(at).alias("x")).select("sequence_id", F.col("x.r").alias("__at"), F.col("x.o").alias("offset"))
    #: Full pieces' numbers follow from their rows, far above and below those of any block.
    whole = alone.select(((F.lit(1 << 62)) + F.col("__row")).alias("sequence_id"), F.col("__row").alias("__at"), F.lit(0).cast("long").alias("offset"))
    seats = seats.unionByName(whole)
    return fixed.join(seats, F.col("__row") == F.col("__at")).select(*names, "sequence_id", "offset")


def op10_pack_gga(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
