"""Byte-pair encoding and decoding through a minimal acyclic transducer of frequent words.

Words are counted over the whole table. The frequent ones, as many as ``LEXICON`` allows, are encoded once and compiled into an
automaton that shares beginnings and endings: states that accept the same rest are one. Every transition adds a number, and the sum
along a word's path is its place in a flat table of ids. The file goes to each executor once and is mapped into memory there, so all
workers of a machine share its pages. Words it does not hold are merged by the ranks of the vocabulary, pair by pair, as exactly.
"""

from __future__ import annotations

import gc
import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import slices, table, texts, tidied, written
from cuetable.llm.token_counts import byte_letters, load, vocabulary_path

#: Most words of the automaton, most bytes of one of them, and how many words a task remembers or counts at a time.
LEXICON, LONGEST, REMEMBERED, STRETCH = 65_536, 64, 400_000, 1 << 18
NO_MERGE = np.iinfo(np.int32).max
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS, ODD_BLANK = re.compile(f"[{BLANK}]+"), re.compile("[\x1c-\x1f]")  # str.split takes the latter as blanks too
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")


def described(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class Merges:
    """Ids of the byte symbols and merges by pair of ids: a few arrays, which travel to tasks."""

    def __init__(self, model: dict):
        held = model["model"]["vocab"]
        end = model["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner, self.last = np.array([held[c] for c in letters], np.int32), np.array([held[c + end] for c in letters], np.int32)
        merges = model["model"]["merges"]
        pairs = np.array([held[a] << 32 | held[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank, self.made = pairs[order], order.astype(np.int32), np.array([held[a + b] for a, b in merges], np.int32)
        born = {a + b: rank for rank, (a, b) in enumerate(merges)}
        if len(born) < len(merges) or any(born.get(x, -1) >= rank for rank, pair in enumerate(merges) for x in pair):
            raise ValueError("a merge comes before the tokens that it joins")
        self.kind = "<u2" if max([*held.values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16 else "<u4"

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not empty, one word after the other, and where each begins.

        In every word, of all neighbours that can merge, those of lowest rank go first, the leftmost among overlapping ones. All words take
        their next step at once: as no merge makes a pair of lower rank than its own, equal pairs of a word need not wait for each other.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word, tail = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)), np.zeros(len(ids), bool)
        tail[ends - 1] = True
        rank = self.ranks(ids, tail, np.arange(len(ids)))
        done_ids, done_word = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == NO_MERGE, size)
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                left = ~over
                ids, word, tail, rank, least = ids[left], word[left], tail[left], rank[left], np.repeat(least, size)[left]
            else:
                least = np.repeat(least, size)
            at = np.flatnonzero(rank == least) if len(ids) else np.zeros(0, np.int64)
            if not len(at):
                break
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # of overlapping pairs every second
            ids[at] = self.made[rank[at]]
            tail[at] = tail[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            before = at[(at > 0)] - 1
            changed[before] = True
            changed[before[~keep[before]] - 1] = True  # before stands for a merged pair
            ids, word, tail, rank, changed = ids[keep], word[keep], tail[keep], rank[keep], np.flatnonzero(changed[keep])
            rank[changed] = self.ranks(ids, tail, changed)
        done_ids, done_word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(done_word, kind="stable")
        done_word = done_word[order]
        return done_ids[order], np.searchsorted(done_word, np.arange(len(words) + 1))

    def ranks(self, ids: np.ndarray, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at``; a word's last symbol begins none."""
        out = np.full(len(at), NO_MERGE, np.int32)
        inside = np.flatnonzero(~tail[at])
        wanted = ids[at[inside]].astype(np.int64) << 32 | ids[at[inside] + 1]
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        held = self.pairs[found] == wanted
        out[inside[held]] = self.pair_rank[found[held]]
        return out


class Vocabulary(Merges):
    """Merges, special strings, and the library's normaliser and splitter."""

    def __init__(self, path: str):
        model = described(path)
        super().__init__(model)
        held = model["model"]["vocab"]
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokenizer = load(path)
        size = max([*held.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in [*held.items(), *self.special.items()]:
            self.strings[i] = token.encode()

    def words(self, chunk: str) -> list[bytes]:
        """The words, as UTF-8, that the library makes of a text without blanks."""
        if PLAIN.fullmatch(chunk):
            low = chunk.lower()
            return [p.encode() for p in ([low] if low.isalpha() else PIECES.findall(low))]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte.__getitem__, piece)) for piece, _ in split]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before blanks alone."""
    at = 0
    while len(text) - at > size and (blank := BLANKS.search(text, at + size)):
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:] if at else text


def chunks(text: str) -> list[str]:
    return [c for c in BLANKS.split(text) if c] if ODD_BLANK.search(text) else text.split()


class Automaton:
    """Minimal acyclic automaton with numbers on its transitions, built from sorted words."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.known: dict[tuple, int] = {}

    def add(self, words: Iterable[bytes]) -> None:
        """Adds distinct words in ascending order; what can no longer change is shared at once."""
        before, path = b"", [0]
        for word in words:
            shared = 0
            while shared < min(len(before), len(word)) and before[shared] == word[shared]:
                shared += 1
            self.settle(path, before, shared)
            for b in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][b] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        self.settle(path, before, 0)

    def settle(self, path: list[int], word: bytes, keep: int) -> None:
        for at in range(len(word), keep, -1):
            state = path.pop()
            same = (self.final[state], *self.arcs[state].items())
            self.arcs[path[-1]][word[at - 1]] = self.known.setdefault(same, state)

    def tables(self) -> tuple[np.ndarray, ...]:
        """``key, to, skip, final``: transitions by state and byte, where they lead, the words that come before, and states that end words."""
        order, number = [0], {0: 0}
        for state in order:
            for to in self.arcs[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            if todo := [to for to in self.arcs[state].values() if to not in below]:
                stack += todo
            else:
                below[stack.pop()] = self.final[state] + sum(below[to] for to in self.arcs[state].values())
        key, to, skip = [], [], []
        for state in order:
            passed = int(self.final[state])
            for b in sorted(self.arcs[state]):
                key.append(number[state] << 8 | b)
                to.append(number[self.arcs[state][b]])
                skip.append(passed)
                passed += below[self.arcs[state][b]]
        return np.array(key, np.int64), np.array(to, np.int32), np.array(skip, np.int32), np.array([self.final[s] for s in order], np.uint8)


PARTS = (("key", np.int64), ("first", np.int64), ("to", np.int32), ("skip", np.int32), ("ids", np.uint32), ("final", np.uint8))


def compiled(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The automaton of ``words`` (ascending, distinct) and their ids as one file: six sizes, then the tables one after the other."""
    own = Automaton()
    own.add(words)
    key, to, skip, final = own.tables()
    ids, first = vocabulary.merged(words)
    held = {"key": key, "to": to, "skip": skip, "final": final, "first": first, "ids": ids}
    return np.array([len(held[name]) for name, _ in PARTS], np.int64).tobytes() + b"".join(held[name].astype(kind).tobytes() for name, kind in PARTS)


class Lexicon:
    """A compiled file mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = 8 * len(PARTS)
        for (name, kind), size in zip(PARTS, np.frombuffer(data, np.int64, len(PARTS)).tolist(), strict=True):
            setattr(self, name, np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for one that is not held; all words go through the automaton side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST)) if len(self.key) else np.zeros(0, np.int64)
        out, state, place = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        step = 0
        while len(live):
            wanted = state[live] << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            held = self.key[arc] == wanted
            live, arc = live[held], arc[held]
            state[live] = self.to[arc]
            place[live] += self.skip[arc]
            step += 1
            ended = lengths[live] == step
            whole = live[ended & (self.final[state[live]] == 1)]
            out[whole] = place[whole]
            live = live[~ended]
        return out


class Codec:
    """Encodes texts and decodes ids; one per task."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.known = Vocabulary(path), lexicon, {}

    def learn(self, found: set[str]) -> dict[str, bytes]:
        """A table with the ids, as bytes, of all chunks in ``found``."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        missing = list(found.difference(self.known))
        split = [self.vocabulary.words(c) for c in missing]
        words = list({w for ws in split for w in ws})
        kind, own = self.vocabulary.kind, self.lexicon
        place = own.places(words)
        held, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids: dict[bytes, bytes] = {}

        def keep(which: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> None:
            raw, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
            ids.update((words[k], raw[a:b]) for k, a, b in zip(which.tolist(), (begin * width).tolist(), (end * width).tolist(), strict=True))

        begin, end = own.first[place[held]], own.first[place[held] + 1]
        at = np.cumsum(end - begin) - (end - begin)
        keep(held, at, at + end - begin, own.ids[np.repeat(begin - at, end - begin) + np.arange(int((end - begin).sum()))])
        values, first = self.vocabulary.merged([words[k] for k in new.tolist()])
        keep(new, first[:-1], first[1:], values)
        self.known.update((c, b"".join([ids[w] for w in ws])) for c, ws in zip(missing, split, strict=True))
        return self.known

    def parts(self, text: str) -> Iterator[str | bytes]:
        """Stretches of text, and the ids of special strings between them."""
        for part in self.vocabulary.specials.split(text) if self.vocabulary.specials else [text]:
            if part in self.vocabulary.special:
                yield np.array([self.vocabulary.special[part]], self.vocabulary.kind).tobytes()
            else:
                yield from stretches(part)

    def encoded(self, values: list[str]) -> list[bytes]:
        """The ids of every text, as unsigned little-endian numbers of the vocabulary's width."""
        specials = self.vocabulary.specials
        split = [chunks(t) if len(t) <= 8 * STRETCH and not (specials and specials.search(t)) else None for t in values]
        known = self.learn(set().union(*(c for c in split if c is not None)))
        out = [b"".join(map(known.__getitem__, c)) if c is not None else b"" for c in split]
        for k in (k for k, c in enumerate(split) if c is None):
            ids = []
            for part in self.parts(values[k]):
                if isinstance(part, str):
                    own = chunks(part)
                    part = b"".join(map(self.learn(set(own)).__getitem__, own))
                ids.append(part)
            out[k] = b"".join(ids)
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of ``ids`` as the library writes it without a decoder: the strings of the tokens between blanks."""
        return b" ".join(map(self.vocabulary.strings.__getitem__, ids.tolist()))


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """``word, n`` over all texts; words longer than the automaton takes are left to merging."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = Vocabulary(path), Counter()

        def flushed() -> pa.RecordBatch:
            counts: Counter = Counter()
            for chunk, n in seen.items():
                for word in vocabulary.words(chunk):
                    if len(word) <= LONGEST:
                        counts[word] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for rows in slices(batch):
                for text in rows.column("text"):
                    for part in stretches(text.as_py()):
                        seen.update(chunks(part))
                        if len(seen) > REMEMBERED:
                            yield flushed()
        yield flushed()

    return texts(docs).mapInArrow(tidied(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON) -> list[bytes]:
    """At most ``most`` words: those that occur at least as often as the smallest power of two that leaves no more."""
    counts = written(word_counts(docs, path).filter("n > 1"), "word_counts")
    power = F.floor(F.log2("n") + 1e-9).cast("int")
    held = {r.power: r["count"] for r in counts.groupBy(power.alias("power")).count().collect()}  # one row a power of two
    least, total = 64, 0
    for p in sorted(held, reverse=True):
        if (total := total + held[p]) > most:
            break
        least = p
    return sorted(bytes(r.word) for r in counts.filter(power >= least).select("word").collect())  # at most ``most``


def shipped(spark: SparkSession, data: bytes) -> str:
    """Name of a file with ``data`` that every executor fetches once; the driver serves it while the session lives."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as file:
        file.write(data)
    spark.sparkContext.addFile(path)
    return name


def lexicon_of(docs: DataFrame, path: str, most: int = LEXICON) -> str:
    """Name of the shipped automaton of the frequent words of ``docs``."""
    words = frequent_words(docs, path, most)
    data = compiled(words, Vocabulary(path))
    gc.collect()
    return shipped(docs.sparkSession, data)


def encode(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit numbers, as the library at ``path`` encodes without special tokens of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            for rows in slices(batch):
                ids = [np.frombuffer(x, own.vocabulary.kind).astype("<u4").tobytes() for x in own.encoded(rows.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(tidied(run), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``, with special tokens kept; unknown ids and a null give nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = np.array(Vocabulary(path).strings, object)
        for batch in batches:
            for rows in slices(batch, "ids"):
                out = []
                for raw in rows.column("ids"):
                    ids = np.frombuffer(raw.as_py(), "<u4")
                    out.append(b" ".join([s for s in strings[ids[ids < len(strings)]] if s]).decode())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    filled = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))
    return filled.mapInArrow(tidied(run), "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``: its ids, and the text they decode to.

    Null and empty texts have no ids and decode to the empty text. Rows are encoded one by one, so repeated rows and null ids need no rule. Special
    strings inside a text are their own ids, as the library has them. Texts are read in stretches between blanks, however long. Other columns are not
    read. An empty table has an empty automaton.
    """
    lexicon = lexicon_of(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            for rows in slices(batch):
                n, ids_hash, text_hash = [], [], []
                for raw in own.encoded(rows.column("text").to_pylist()):
                    ids = np.frombuffer(raw, own.vocabulary.kind)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(own.decoded(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(tidied(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op13_bpe_round_trip": op13_bpe_round_trip}
ORACLES: dict[str, str] = {}
