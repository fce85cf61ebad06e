"""Whole texts to token ids with the ``tokenizers`` library, through a bounded table of words on each worker.

Numpy finds the words of a few texts, and for each a 64-bit key and a second 64-bit number that confirms it; keys are
looked up in a table by a few runs of their bits, and ids are gathered from its pool. Words that share a key and differ in
the second number are encoded apart. Only words that the table lacks become strings and go to the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that the table holds, and places where one may lie.
TABLE_WORDS = 1_000_000
PROBES = 4
#: Bytes of text in work at a time, where memory is a few times that, where texts are gathered, and where words are found.
SLICE_CHARS = 4_000_000
GATHER_CHARS = 4_000_000
NEAR_CHARS = 500_000
#: Words that the library encodes as one text, and such texts that it gets at once.
JOINED = 512
TOGETHER = 16
#: Words of up to so many bytes get their key from numpy, longer ones from a hash function.
SHORT = 32
_ASCII_SPACES = tuple(" \t\n\x0b\x0c\r")

#: No token reaches over the border of letters and signs: the tokenizers split them before they merge. Apostrophes aren't
#: among the signs, since "'s" and the like are split off with their letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: U+0130 isn't among the letters: in lower case it is two characters, and the second is no letter.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")

#: By byte: 1 for ASCII letters, 2 for SIGNS, 4 for the first byte of letters of two bytes.
_KINDS = bytearray(256)
for _of, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1), (SIGNS.encode(), 2), (range(0xC3, 0xC9), 4)):
    for _byte in _of:
        _KINDS[_byte] = _kind

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_odd = np.random.default_rng(20_241_105).integers(0, 2**63, SHORT // 8 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHECK = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``chars`` bytes of ``column``: one long text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def gathered(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """``batches`` as ones of about GATHER_CHARS bytes of ``column``, whatever the size they come in."""
    waiting, size = [], 0
    for batch in batches:
        for part in slices(batch, column, GATHER_CHARS):
            waiting.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= GATHER_CHARS // 2:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word, eight bytes at a time, each mixed with what came before; and another 64-bit number of it,
    a polynomial of the same bytes."""
    buffer = data + bytes(SHORT)
    eights = np.ndarray((len(data) + SHORT - 7,), "<u8", buffer, strides=(1,))
    checks = lengths.astype(np.uint64)
    keys = _mixed(checks * _odd[0])
    part = eights[starts] & _KEEP[np.minimum(lengths, 8)]
    keys = _mixed((keys ^ part) * _odd[1])
    checks = checks * _CHECK + part
    some = np.flatnonzero(lengths > 8)
    for k in range(1, SHORT // 8):
        if not len(some):
            return keys, checks
        rest = lengths[some] - 8 * k
        part = eights[starts[some] + 8 * k] & _KEEP[np.minimum(rest, 8)]
        keys[some] = _mixed((keys[some] ^ part) * _odd[k + 1])
        checks[some] = checks[some] * _CHECK + part
        some = some[rest > 8]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        digest = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + lengths[i]])
        keys[i], checks[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    return keys, checks


class _Table:
    """Ids by key of a word. Words have numbers in the order in which they came, from 1 on; each has a row that is read at once:
    its key, its second number, then the place and number of its ids in a pool, and when it was used last. PROBES runs of a
    key's bits say where in ``slots`` its number may lie; a word that finds all of these taken is forgotten."""

    def __init__(self):
        self.rows, self.pool = np.zeros((1, 4), np.uint64), np.zeros(1, np.uint16)
        self.n, self.n_ids, self.now = 1, 0, 0
        self._lay()

    @staticmethod
    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of ids, numbers of ids, times of the last use) of ``rows``."""
        narrow = rows.view(np.int32)
        return narrow[:, 4], narrow[:, 5], narrow[:, 6]

    def _lay(self) -> None:
        self.bits = max(16, (2 * self.n).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self._put(np.arange(1, self.n, dtype=np.int32))

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits - 10 * probe) & np.uint64((1 << self.bits) - 1)).view(np.int64)

    def _put(self, numbers: np.ndarray) -> None:
        for probe in range(PROBES):
            at = self._slot(self.rows[numbers, 0], probe)
            free = self.slots[at] == 0
            self.slots[at[free]] = numbers[free]
            numbers = numbers[self.slots[at] != numbers]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``keys``, places of those that aren't there)."""
        self.now += 1
        at = self.slots.take(self._slot(keys, 0))
        rows = self.rows.take(at, axis=0)
        lacking = np.flatnonzero(rows[:, 0] != keys)
        for probe in range(1, PROBES):
            own = keys[lacking]
            at[lacking] = found = self.slots.take(self._slot(own, probe))
            rows[lacking] = tried = self.rows.take(found, axis=0)
            lacking = lacking[tried[:, 0] != own]
        self.places(self.rows)[2][at] = self.now
        return rows, lacking

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """The rows of these new words."""
        counts, flat = np.fromiter(map(len, ids), np.int32, len(ids)) // 2, np.frombuffer(b"".join(ids), "<u2")
        first, end, ids_end = self.n, self.n + len(keys), self.n_ids + len(flat)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((end - len(self.rows) + end // 2, 4), np.uint64)])
        if ids_end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(ids_end - len(self.pool) + ids_end // 2, np.uint16)])
        new = self.rows[first:end]
        new[:, 0], new[:, 1] = keys, checks
        for column, values in zip(self.places(new), (self.n_ids + np.cumsum(counts) - counts, counts, self.now), strict=True):
            column[:] = values
        self.pool[self.n_ids : ids_end] = flat
        self.n, self.n_ids = end, ids_end
        if 2 * end > 1 << self.bits:
            self._lay()
        else:
            self._put(np.arange(first, end, dtype=np.int32))
        return new

    def shrink(self) -> None:
        """Forget the half that was used least lately, if there are too many."""
        if self.n > TABLE_WORDS:
            stay = np.argpartition(self.places(self.rows)[2][1 : self.n], self.n // 2)[self.n // 2 :]
            self.rows = self.rows[np.append(0, np.sort(stay) + 1)]
            starts, counts, _ = self.places(self.rows)
            self.pool = self.ids(starts, counts)
            starts[:] = np.cumsum(counts) - counts
            self.n, self.n_ids = len(self.rows), len(self.pool)
            self._lay()

    def ids(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids at all of ``starts``, one run after another."""
        ends = np.cumsum(counts)
        place = np.repeat(starts - (ends - counts), counts)
        place += np.arange(len(place))
        return self.pool[place]


class _Encoder:
    """Ids of texts in 16 bits: a text's ids are those of its words in turn, whatever a tokenizer lets count as words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids need more than 16 bits")
        self.table = _Table()

    def _alone(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``, each given to the library by itself."""
        return [np.array(x.ids, "<u2").tobytes() for x in _batches(self.tokenizer, words, JOINED * TOGETHER)]

    def _words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of the words of texts that lie between ``offsets`` of ``data``."""
        raise NotImplementedError

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts`` one after another, number of ids of each); null texts are empty."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        ids, lengths, first = [np.empty(0, np.uint16)], [np.empty(0, np.int64)], 0
        while first < len(texts):  # so few at a time that what is found of them stays near
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + NEAR_CHARS, side="right")) - 1)
            near = offsets[first : last + 1]
            data = texts.buffers()[2][int(near[0]) : int(near[-1])].to_pybytes() if near[-1] > near[0] else b""
            found, n = self._encode(data, near - near[0]) if data else (ids[0], np.zeros(last - first, np.int64))
            ids.append(found)
            lengths.append(n)
            first = last
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.table
        starts, lengths = self._words(data, offsets)
        keys, checks = word_keys(data, starts, lengths)
        rows, lacking = table.find(keys)
        if len(lacking):
            _, first, which = np.unique(keys[lacking], return_index=True, return_inverse=True)
            first = lacking[first]
            rows[lacking] = table.add(keys[first], checks[first], self._encoded(_strings(data, starts[first], lengths[first])))[which]
        places, counts, _ = table.places(rows)
        other = np.flatnonzero(rows[:, 1] != checks)
        if len(other):  # words that share their key with another one
            apart = self._encoded(_strings(data, starts[other], lengths[other]))
            counts[other], places[other] = 0, 0
        ids = table.ids(places, counts)
        if len(other):
            ids, counts = _put(ids, counts, other, apart)
        ends = np.append(0, np.cumsum(counts))
        table.shrink()
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])


def _batches(tokenizer, texts: list[str], most: int) -> Iterator:
    """The library's results for ``texts``, which it gets ``most`` at once."""
    for k in range(0, len(texts), most):
        yield from tokenizer.encode_batch_fast(texts[k : k + most], add_special_tokens=False)


def _split(data: bytes, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words start, from ``begins``, which is true where they do, and the places in them between a letter (of ASCII, or of two bytes
    up to U+023F but for U+0130) and a sign, but not of words that may hold a special token's name. Copies of a word with
    other signs around it are then one word, and the signs another."""
    kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    lead = np.flatnonzero(kinds == 4)
    if len(lead):
        pair = flat[lead].astype(np.uint16) << 8 | flat[lead + 1]
        kinds[lead] = 0
        lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
        kinds[lead] = kinds[lead + 1] = 1
    cuts = kinds[1:] + kinds[:-1] == 3
    bars = np.flatnonzero((flat[:-1] == 0x3C) & (flat[1:] == 0x7C))
    if len(bars):
        starts = np.flatnonzero(begins)
        special = np.zeros(len(starts) + 1, bool)
        special[np.searchsorted(starts, bars, side="right")] = True
        at = np.flatnonzero(cuts)
        cuts[at[special[np.searchsorted(starts, at + 1, side="right")]]] = False
    begins[1:] |= cuts
    return np.flatnonzero(begins)


def _at(offsets: np.ndarray) -> np.ndarray:
    """For each byte whether a text starts there."""
    begins = np.zeros(offsets[-1] + 1, bool)
    begins[offsets] = True
    return begins[:-1]


def _strings(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]


def _put(ids: np.ndarray, counts: np.ndarray, at: np.ndarray, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` and ``counts`` with ``runs`` at the words ``at``, which had none."""
    counts = counts.copy()
    ends = np.cumsum(counts)
    n = np.fromiter(map(len, runs), np.int64, len(runs)) // 2
    ids = np.insert(ids, np.repeat(ends[at], n), np.frombuffer(b"".join(runs), "<u2"))
    counts[at] = n
    return ids, counts


class WordEncoder(_Encoder):
    """Ids of texts by a tokenizer that drops spaces between words.

    A space or line end always ends a word for such a tokenizer, and so does the border between a letter and a sign. What
    is all letters or all signs is one word to it, so many of these are encoded as one text and told apart by their ends.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # The same model without the steps that change nothing in lower-case ASCII letters between spaces.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(65536, bool)  # ids that end a word
        for token, id_ in self.tokenizer.get_vocab().items():
            self.last[id_] = token.endswith("</w>")

    def _joined(self, tokenizer, words: list[str], at: list[int], out: list[bytes]) -> None:
        """Puts the ids of ``words`` at the places ``at`` of ``out``."""
        runs = range(0, len(words), JOINED)
        for k, encoded in zip(runs, _batches(tokenizer, [" ".join(words[k : k + JOINED]) for k in runs], TOGETHER), strict=True):
            ids = np.array(encoded.ids, "<u2")
            ends = np.flatnonzero(self.last[ids])
            places = at[k : k + JOINED]
            if len(ends) != len(places) or ends[-1] != len(ids) - 1:  # a word that isn't one to the library
                for place, alone in zip(places, self._alone(words[k : k + JOINED]), strict=True):
                    out[place] = alone
                continue
            flat, before = ids.tobytes(), 0
            for place, end in zip(places, (2 * ends + 2).tolist(), strict=True):
                out[place] = flat[before:end]
                before = end

    def _encoded(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        self._joined(self.plain, [words[i].lower() for i in plain], plain, out)
        others = sorted({*range(len(words))}.difference(plain))
        one = [i for i in others if LETTERS.fullmatch(words[i]) or not words[i].strip(SIGNS) and "<|" not in words[i]]
        self._joined(self.tokenizer, [words[i] for i in one], one, out)
        rest = sorted({*others}.difference(one))
        for i, ids in zip(rest, self._alone([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A word begins at a text, after a space or line end, and at one, which is a word without ids.
        flat = np.frombuffer(data, np.uint8)
        blank = (flat == 32) | (flat == 10)
        begins = _at(offsets)
        begins[1:] |= blank[1:] != blank[:-1]
        starts = _split(data, flat, begins)
        some = ~blank[starts]
        return starts[some], np.diff(starts, append=offsets[-1])[some]


class ByteEncoder(_Encoder):
    """Ids of texts by a byte-level tokenizer, which keeps spaces: a word here is a run of white space and what follows it.

    Such a tokenizer's pattern never matches across the start of white space after something else, and looks no further
    than the end of the white space, so such words are encoded alike alone and in their text. Only ASCII white space
    counts; after a character that may be other white space a word goes on.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.opens, self.closes = np.zeros(65536, bool), np.zeros(65536, bool)  # ids that begin, and that end, with white space
        for id_ in self.tokenizer.get_vocab().values():
            token = self.tokenizer.decode([id_], skip_special_tokens=False)
            self.opens[id_], self.closes[id_] = token[:1] in _ASCII_SPACES, token[-1:] in _ASCII_SPACES

    def _words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(data, np.uint8)
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        high = np.flatnonzero(flat[cuts - 1] >= 0x80)
        before, third = flat[np.maximum(cuts[high] - 2, 0)], flat[np.maximum(cuts[high] - 3, 0)]
        cuts = np.delete(cuts, high[(before == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))])
        begins = _at(offsets)
        begins[cuts] = True
        starts = _split(data, flat, begins)
        return starts, np.diff(starts, append=offsets[-1])

    def _encoded(self, words: list[str]) -> list[bytes]:
        joint = [w[0] in _ASCII_SPACES and len(w.split()) == 1 and "<|" not in w for w in words]
        ids: list[bytes] = [b""] * len(words)
        alone = [i for i, x in enumerate(joint) if not x]
        many = [i for i, x in enumerate(joint) if x]
        runs = [many[at : at + JOINED] for at in range(0, len(many), JOINED)]
        for run, encoded in zip(runs, _batches(self.tokenizer, ["".join(words[i] for i in run) for run in runs], TOGETHER), strict=True):
            found = np.array(encoded.ids, "<u2")
            begins = np.flatnonzero(self.opens[found] & ~np.append(False, self.closes[found[:-1]])).tolist()
            if len(begins) != len(run) or begins[0]:
                alone += run
                continue
            flat = found.tobytes()
            for i, a, b in zip(run, begins, [*begins[1:], len(found)], strict=True):
                ids[i] = flat[2 * a : 2 * b]
        for i, encoded in zip(alone, self._alone([words[i] for i in alone]), strict=True):
            ids[i] = encoded
        return ids


_encoders: dict[tuple[str, type], _Encoder] = {}


def word_encoder(path: str, kind: type[_Encoder] = WordEncoder) -> _Encoder:
    """This worker's encoder: tasks that follow one another on a worker share its table."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = kind(path)
    return _encoders[path, kind]
