"""Token counts by the whole-token shortcut, and the ids behind them.

The tokenizer lower-cases, drops blanks and never merges across them, so a text is counted word by word. Which strings of the
vocabulary encode alone as one token is proved once, on the driver, by encoding each of them. A pre-token among them counts one;
the rest are merged by the library, each distinct one once per task while a bounded memory lasts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cuetable.llm.common import slices, table, texts, tidied

VOCABULARY, LIMIT, REMEMBERED = "word_bpe_49k.json", 2048, 500_000
#: Texts of these characters alone look the same to this module and to the library's normaliser; others go to the library whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def whole_tokens(path: str) -> dict[str, int]:
    """Strings that are one pre-token and encode alone as one token, with its id."""
    tokenizer = load(path)
    spelled = {c: b for b, c in enumerate(byte_letters())}
    ended = (v.removesuffix("</w>") for v in tokenizer.get_vocab() if v.endswith("</w>"))
    strings = sorted({bytes(map(spelled.get, v)).decode(errors="replace") for v in ended if v and all(c in spelled for c in v)})
    strings = [s for s in strings if PLAIN.fullmatch(s) and s == s.lower() and PIECES.findall(s) == [s]]
    return {s: e.ids[0] for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1}


def plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


class Encoder:
    """Token ids, or their number, of blank-free words; one per task, so that a worker holds none between tasks."""

    remembered = REMEMBERED

    def __init__(self, path: str, whole: dict[str, int], ids: bool):
        self.path, self.ids = path, ids
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        self.ends[[i for v, i in self.tokenizer.get_vocab().items() if v.endswith("</w>")]] = True
        self.whole = {s: self.value([i]) for s, i in whole.items()}
        self.words = dict(self.whole)

    @cached_property
    def tokenizer(self):
        return load(self.path)

    def value(self, ids: list[int]):
        return np.array(ids, self.kind).tobytes() if self.ids else len(ids)

    def merged(self, pieces: list[str]) -> list:
        """The library's answer for every piece; a token that ends a word ends its piece."""
        out: list = []
        for at in range(0, len(pieces), 5_000):
            ids = np.array(self.tokenizer.encode(" ".join(pieces[at:at + 5_000]), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if self.ids:
                raw, width = ids.tobytes(), ids.itemsize
                to = (cuts * width).tolist()
                out += [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]
            else:
                out += np.diff(cuts, prepend=0).tolist()
        return out

    def learn(self, words: set[str]) -> dict:
        """Adds the words not yet known; the returned table has all of ``words``."""
        if len(self.words) > self.remembered:  # what comes again is kept
            self.words = self.whole | {w: self.words[w] for w in words if w in self.words}
        known = self.words
        missing = words.difference(known)
        split = {w: PIECES.findall(w) for w in missing if not w.isalpha()}
        rest = missing.difference(split).union(*split.values()).difference(known)
        rest = list(rest)
        known.update(zip(rest, self.merged(rest), strict=True))
        join = b"".join if self.ids else sum
        for w, pieces in split.items():
            known[w] = join([known[p] for p in pieces])
        return known

    def encoded(self, values: list[str]) -> list:
        """For every text its number of tokens, or its ids as bytes."""
        split = [t.lower().split() if plain(t) else None for t in values]
        known = self.learn(set().union(*(w for w in split if w is not None)))
        join = b"".join if self.ids else sum
        return [join(map(known.__getitem__, w)) if w is not None else self.value(self.tokenizer.encode(t, add_special_tokens=False).ids)
                for t, w in zip(values, split, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, as the library at ``path`` counts.

    Null and empty texts have no bytes and no tokens. Rows are counted one by one, so repeated rows and null ids need no rule; other
    columns are not read. The table of whole tokens is as large as the vocabulary at most.
    """
    whole = whole_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path, whole, ids=False)
        for batch in batches:
            for rows in slices(batch, limit=2 << 20):
                n = pa.array(own.encoded(rows.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pc.binary_length(rows.column("text")).cast(pa.int64()), n, pc.greater(n, limit)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(tidied(count), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
