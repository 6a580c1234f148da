"""Packing documents into fixed-length token sequences by order-preserving dynamic programming.

The documents of a partition form one stream of tokens in their order.  Cuts may stand at document ends (free), sentence ends
(a small penalty) and, inside sentences that are too long, at regular steps (a larger one).  The cuts that minimise padding
plus penalties satisfy
    f(j) = penalty(j) + L - p(j) + min { f(i) + p(i) : p(j) - p(i) <= L },
a sliding minimum that a monotone queue keeps, so a stream takes time in proportion to its cuts.  What is left at the end of
a partition is cut into powers of two, which take no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import slices

LENGTH = 2048
#: Cost, in padded tokens, of a cut at a sentence end and inside a sentence; distance of the cuts inside one.
AT_SENTENCE, INSIDE, STEP = 4, 12, 64
#: Tokens that are solved together, words that a task remembers, and new words that are encoded as one text.
SEGMENT, REMEMBERED, TOGETHER = 1 << 18, 400_000, 50
#: The letters and numbers among PLAIN, and the tokenizer's own way to cut text into words, for those.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
#: In these characters, one by one, lower() and the word pattern agree between libraries, and nothing composes.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-įı-ſ]*"
#: The normaliser and the word cutter of a tokenizer file for which WORDS and PLAIN are right.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def spans(raw: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches of WORDS in lower-cased plain text, given as UTF-8 that begins and ends with white space: where they begin, and which
    bytes are theirs.  kinds: of each code point 0 for white space, 1 for letters, 2 for numbers, else 3."""
    kind = kinds[raw]  # of ASCII as it is
    lead = np.flatnonzero(raw >= 0xC0)  # all others take two bytes
    kind[lead] = kind[lead + 1] = kinds[(raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F]
    begins = np.zeros(len(raw), bool)
    begins[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0)
    begins[lead + 1] = False
    # 's, 't, 're, 've, 'm, 'll, 'd are words of their own where nothing but letters and white space touches the apostrophe
    at = np.flatnonzero(raw == 0x27)
    at = at[begins[at] & (kind[at + 1] == 1)]
    first, second = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    for own, size in ((at[one], 1), (at[two], 2)):
        begins[own + 1] = False
        begins[own + size + 1] |= kind[own + size + 1] == 1
    return np.flatnonzero(begins), kind > 0


class _Rows:
    """Rows of token ids one after another, in arrays that double when they are full."""

    def __init__(self) -> None:
        self.flat, self.size, self.at, self.rows = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Rows that end before these places of values."""
        while self.size + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while self.rows + len(ends) >= len(self.at):
            self.at = np.concatenate([self.at, self.at])
        self.flat[self.size : self.size + len(values)] = values
        self.at[self.rows + 1 : self.rows + len(ends) + 1] = self.size + ends
        self.size, self.rows = self.size + len(values), self.rows + len(ends)


class WordEncoder:
    """Token ids of texts.

    Words of plain texts are encoded once each and remembered, if the tokenizer cuts and marks words in the one way that this
    knows; other texts, and all texts of other tokenizers, go through the tokenizer whole.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.plain = re.compile(PLAIN).fullmatch
        self.kinds = np.array([0 if re.match(r"\s", c) else 1 if re.match(f"[{LETTER}]", c) else 2 if re.match(f"[{NUMBER}]", c) else 3 for c in map(chr, range(0x180))], np.uint8)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.codes, self.rows = {}, _Rows()
        d = json.loads(definition)
        self.by_word = d.get("normalizer") == NORMALIZER and d.get("pre_tokenizer") == CUTTER and not d.get("post_processor") and d["model"].get("end_of_word_suffix") == "</w>" and all("<|" in t["content"] for t in d.get("added_tokens") or [])
        # for words that are cut and lower-cased: the same model without the steps that do so
        self.words = Tokenizer.from_str(json.dumps(d | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, CUTTER["pretokenizers"][1]]}})) if self.by_word else self.tokenizer

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that were not met before, TOGETHER at a time; their last tokens tell them apart."""
        lines = [b" ".join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not mark the ends of words")
        self.rows.add(ids, ends)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of plain texts, one after another, and how many each text has."""
        said = [t.lower().encode() for t in texts]
        raw = np.frombuffer(b"\n" + b"\n".join(said) + b"\n", np.uint8)
        start, inside = spans(raw, self.kinds)
        places = np.append(0, np.cumsum(inside))  # of bytes among those of words
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(places[start], places[-1]).astype(np.int32)), pa.py_buffer(raw[inside])]).dictionary_encode()
        each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.codes.get, each, repeat(-1)), dtype=np.int64, count=len(each))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            number[unknown] = np.arange(len(self.codes), len(self.codes) + len(unknown))
            new = [each[k] for k in unknown.tolist()]
            self.codes.update(zip(new, number[unknown].tolist(), strict=True))
            self._learn(new)
        upto = np.cumsum([len(x) + 1 for x in said])
        return number[words.indices.to_numpy()], np.diff(np.searchsorted(start, np.append(0, upto)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if len(self.codes) > REMEMBERED:
            self.codes, self.rows = {}, _Rows()
        plain, whole = [], {}
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if self.by_word and self.plain(t) and "<|" not in t:
                plain.append(k)
            elif t:
                whole[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        word = np.zeros(0, dtype=np.int64)
        if plain:
            word, counts[plain] = self._numbers([texts[k] for k in plain])
        at = self.rows.at[word]
        size = self.rows.at[word + 1] - at
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.rows.flat[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        bound = ends[np.concatenate([[0], np.cumsum(counts)])]
        total = np.diff(bound)
        if whole:
            parts = np.split(ids, bound[1:-1])
            for k, e in whole.items():
                parts[k], total[k] = e, len(e)
            ids = np.concatenate(parts)
        return ids, total


def best_cuts(place: list[int], penalty: list[int], length: int) -> tuple[list[float], list[int]]:
    """Cost of the best cuts up to each place, and the cut before it.  place ascends from 0 by steps of at most length."""
    cost, before = [0.0] * len(place), [0] * len(place)
    queue, least, first = [0], [0.0], 0  # i, f(i) + p(i) of what is queued, smallest first, from `first` on
    for j in range(1, len(place)):
        p = place[j]
        while p - place[queue[first]] > length:
            first += 1
        before[j] = queue[first]
        value = penalty[j] + length + least[first]
        cost[j] = value - p
        while len(least) > first and least[-1] >= value:
            queue.pop()
            least.pop()
        queue.append(j)
        least.append(value)
    return cost, before


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(definition, length: int, stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(definition.value)
        enders = np.array(sorted({encoder.tokenizer.encode(x, add_special_tokens=False).ids[-1] for x in ".!?"}), dtype=np.uint32)
        sequence = TaskContext.get().partitionId() << 36
        stream: list[np.ndarray] = []  # tokens not yet dealt
        docs: list[tuple[object, int, int]] = []  # id, place of its first token in the stream (negative if dealt), tokens
        size = 0

        def deal(last: bool):
            nonlocal stream, docs, size, sequence
            ids = np.concatenate(stream) if stream else np.zeros(0, np.uint32)
            first = np.array([d[1] for d in docs], dtype=np.int64)
            total = np.array([d[2] for d in docs], dtype=np.int64)
            cut = np.full(len(ids) + 1, -1, dtype=np.int32)
            cut[1:][np.isin(ids, enders)] = AT_SENTENCE
            cut[first + total] = 0
            cut[0] = 0
            open_ = np.flatnonzero(cut >= 0)
            gap = np.diff(open_)
            wide = np.flatnonzero(gap > STEP)
            n = (gap[wide] - 1) // STEP
            inner = np.repeat(open_[wide], n) + STEP * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
            cut[inner] = INSIDE
            places = np.flatnonzero(cut >= 0)
            cost, before = best_cuts(places.tolist(), cut[places].tolist(), length)
            # the rest travels on; at the end of the partition it is cut into powers of two
            near = np.flatnonzero(places > len(ids) - length)
            j = int(near[np.argmin(np.array(cost)[near])])
            ends = []
            while j:
                ends.append(int(places[j]))
                j = before[j]
            ends.reverse()
            done = ends[-1] if ends else 0
            if last:
                for p in powers(len(ids) - done):
                    ends.append((ends[-1] if ends else 0) + p)
                done = len(ids)
            out: list[list[int]] = [[] for _ in range(7)]
            if ends:
                bounds = np.array([0, *ends])
                number = sequence + np.arange(len(ends))
                sequence += len(ends)
                edge = np.unique(np.concatenate([bounds, np.clip(first, 0, done), np.clip(first + total, 0, done)]))
                a, b = edge[:-1], edge[1:]
                d = np.searchsorted(first, a, "right") - 1
                s = np.searchsorted(bounds, a, "right") - 1
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                out = [[docs[k][0] for k in d.tolist()], a - first[d], b - a, crc, total[d], number[s], a - bounds[s]]
            keep = [k for k in range(len(docs)) if first[k] + total[k] > done]
            docs = [(docs[k][0], int(first[k]) - done, int(total[k])) for k in keep]
            stream, size = [ids[done:]], len(ids) - done
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], _NAMES)

        for batch in slices(batches):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto]) < SEGMENT):
                    chars += len(texts[upto])
                    upto += 1
                ids, counts = encoder.encode(texts[at:upto])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, stop)
                start = size + np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]])
                docs += zip(names[at:upto], start.tolist(), (counts + 1).tolist(), strict=True)
                stream.append(ids)
                size += len(ids)
                at = upto
                if size >= SEGMENT:
                    yield from deal(False)
        if size:
            yield from deal(True)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stop: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file at path `tokenizer` without special tokens, then `stop`; each lies in
    exactly one piece.  A null or empty text is the id `stop` alone.  Documents keep the order that they have in their input
    partition, and a sequence never mixes partitions.  A null doc_id is packed like any other; rows that share a doc_id are
    packed each.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return data.mapInArrow(_pack(definition, length, stop), _FIELDS)
