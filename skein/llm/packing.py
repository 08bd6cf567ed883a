"""Best-fit packing of token sequences.

Documents are tokenised in Arrow batches, cut into pieces of at most ``capacity`` tokens only where they
are longer, and the pieces (a few numbers each, not their tokens) are dealt into groups of bounded size by
the hash of their document. Each group is packed on its own: a bin takes the largest piece that fits until
none does; then its smallest piece gives way to the two unpacked pieces that fill the widened gap best, if
they fill it better. Only a group's last bins stay half empty, so groups of tens of thousands cost nothing.

Defined cases: a null text is empty and is the single token ``end_id``; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, text_of

#: Letters (a-z, or beyond ASCII), then ASCII punctuation: for the tokenizer one piece each.
WORD_PARTS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)").fullmatch
LATIN_END = "\u0250"
#: How byte-level models write bytes: printable ones as they are, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = b"<|"
MARK = "\x01"


class Ids(dict):
    """Word to its token ids, packed as little-endian 32-bit numbers.

    The tokenizer never joins two words over white space, so a text's ids are its words' ids. Words are
    lower-cased (ASCII) before, as the tokenizer does itself, unless the text may hold a special token.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.coder, self.most = Tokenizer.from_file(path), most
        self.model = self.coder.model
        mark = self.encode(MARK)
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None

    def letters(self, piece: str) -> bytes:
        """Ids of letters alone: one piece for the tokenizer, given to its model as it stands."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def encode(self, text: str) -> bytes:
        return np.asarray(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, missing: set[bytes], hold: bool = False) -> None:
        """Adds words. A table that would be too large is emptied first, unless ``hold``: one text's own words must be there together."""
        if not hold and len(self) + len(missing) > self.most:
            self.clear()
        tails, plain = [], set()
        for w in missing:
            m = WORD_PARTS(w)
            if not m:
                plain.add(w)
                continue
            core, tail = m.groups()
            if core not in self:
                s = core.decode("utf-8", "replace")
                if not s.isascii():  # Latin letters only
                    s = s.lower()
                    if not (s.isalpha() and max(s) < LATIN_END and is_normalized("NFC", s)):
                        plain.add(w)
                        continue
                    s = s.encode().decode("latin-1").translate(BYTE_CHARS)
                self[core] = self.letters(s)
            if tail:
                tails.append((w, core, tail))
                if tail not in self:
                    plain.add(tail)
        odd = [w for w in plain if self.mark is None or b"\x01" in w]
        even = [w for w in plain if not (self.mark is None or b"\x01" in w)]
        for k in range(0, len(even), 4000):
            some = even[k : k + 4000]
            ids = np.asarray(self.coder.encode_batch_fast([f" {MARK} ".join(w.decode("utf-8", "replace") for w in some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some) - 1:
                odd += some
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist(), 4 * (len(ids) + 1)]
            for w, a, b in zip(some, cuts, cuts[1:], strict=False):
                self[w] = raw[a : b - 4]
        for w in odd:
            self[w] = self.encode(w.decode("utf-8", "replace"))
        for w, core, tail in tails:
            self[w] = self[core] + self[tail]

    def of(self, text: bytes) -> bytes:
        ws = (text if SPECIAL in text else text.lower()).split()
        try:
            return b"".join(map(self.__getitem__, ws))
        except KeyError:
            self.learn({w for w in set(ws) if w not in self})
            if not all(map(self.__contains__, ws)):  # the table was emptied: learn the whole text's words
                self.learn({w for w in set(ws) if w not in self}, hold=True)
            return b"".join(map(self.__getitem__, ws))


_CODERS: dict[str, Ids] = {}


def coder(path: str) -> Ids:
    if path not in _CODERS:
        _CODERS[path] = Ids(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and its ids as bytes if ``keep_ids``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        c, rows, blobs, width = coder(tokenizer), [], [], 4 * capacity
        known, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        c.learn({w for t in texts if SPECIAL not in t for w in set(t.lower().split()) if w not in c})
        for doc_id, text in zip(known, texts, strict=True):
            raw = c.of(text) + end
            for k in range(0, len(raw), width):
                part = raw[k : k + width]
                rows.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
                if keep_ids:
                    blobs.append(part)
        arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            arrays.append(pa.array(blobs, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    # workers live on after a task, beside those of other steps: the table of words goes, the tokenizer stays
    return by_batch(text_of(docs), cut, PIECES + (", ids binary" if keep_ids else ""), after=lambda: coder(tokenizer).clear())


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each piece. lengths: from 1 to capacity."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    free = np.bincount(lengths, minlength=capacity + 1)
    top = np.cumsum(free)  # order[top[l] - 1] is an unpacked piece of length l
    bins, places = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    number, rest = 0, len(lengths)

    def most(x: int) -> int:
        """The largest length up to x that is left, or 0."""
        while x > 0:
            low = max(0, x - 255)
            found = np.flatnonzero(free[low : x + 1])
            if len(found):
                return int(low + found[-1])
            x = low - 1
        return 0

    while rest:
        held, gap = [], capacity
        while gap and (got := most(gap)):
            held.append(got)
            free[got] -= 1
            gap -= got
        small = held[-1]
        wide = gap + small
        if gap and len(held) > 1:
            have = np.flatnonzero(free[: wide + 1])
            have = have[have > 0]
            if len(have):
                at = np.searchsorted(have, wide - have, "right") - 1  # each one's largest partner
                with_self = (at >= 0) & (have[np.maximum(at, 0)] == have) & (free[have] < 2)
                at = np.where(with_self, at - 1, at)
                total = np.where(at >= 0, have + have[np.maximum(at, 0)], 0)
                k = int(np.argmax(total))
                if total[k] > small:
                    held.pop()
                    free[small] += 1
                    for x in (int(have[k]), int(have[at[k]])):
                        held.append(x)
                        free[x] -= 1
        where = 0
        for x in held:
            top[x] -= 1
            i = order[top[x]]
            bins[i], places[i] = number, where
            where += x
        rest -= len(held)
        number += 1
    return bins, places


def place(cut: DataFrame, documents: int, capacity: int = 2048, group_docs: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. Groups: by the hash of doc_id and piece, for about ``group_docs`` documents each."""
    groups = max(1, -(-documents // group_docs))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins, places = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="g").assign(sequence_id=bins * groups + int(key[0]), offset=places)

    grouped = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")).groupBy("g")
    return grouped.applyInPandas(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return place(pieces(docs, tokenizer, capacity, end_id), docs.count(), capacity)


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """sequence_id and its ids (32-bit little-endian bytes): the pieces of each sequence joined in order."""
    both = placed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    rows = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
