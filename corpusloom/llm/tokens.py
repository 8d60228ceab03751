"""Token ids of whole texts by a public tokenizer, with repeated segments encoded once."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.common import Hasher, distinct, slices, worker_state

END_ID = 0  # appended to every document
CACHED_SEGMENTS = 1_500_000
JOINED = 128  # segments encoded as one text


def tokenizer_file(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two characters that are surely not white space.

    Byte-level BPE splits a text there whatever surrounds it: a run of letters, digits or signs
    ends before white space, and the next one takes the single space before it.
    """
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = True
    lead = plain.copy()
    lead[0xC3:0xE0] = True  # two-byte characters from U+00C0 on: none is white space
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    ahead = lead[data[at + 1]]
    second = np.maximum(at - 2, 0)
    behind = plain[data[at - 1]] | ((data[at - 1] >= 0x80) & (data[second] >= 0xC3) & (data[second] < 0xE0) & (at >= 2))
    return at[ahead & behind]


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last seven bytes of each range, or all of it, and its length: tells apart equal hashes."""
    found = (ends - starts).astype(np.uint64) << np.uint64(56)
    for i in range(1, 8):
        at = ends - i
        found ^= np.where(at >= starts, data[at], 0).astype(np.uint64) << np.uint64(8 * i - 8)
    return found


class Encoder:
    """Encodes texts as the tokenizer does, segment by segment; known segments are looked up.

    Only tokenizers that split before single spaces may be used this way; ``segments=False``
    encodes every text whole.
    """

    def __init__(self, path: str | None = None, segments: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread holds memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(path))
        self.segments = segments
        self.hasher = Hasher(7)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word.encode()) if i in added else len(word)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted, with the last bytes and the place of each
        self.checks = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)  # of all known segments, one after another
        self.ends = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        lists = self._encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        flat = np.fromiter((i for ids in lists for i in ids), np.int32)
        return flat, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``whole`` for segments between two cuts: many are encoded as one text, whose
        tokens are told apart by their bytes."""
        raw, sizes = data.tobytes(), ends - starts
        texts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        joined = [b"".join(texts[i : i + JOINED]).decode() for i in range(0, len(texts), JOINED)]
        lists = self._encode(joined)
        flat = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        passed = np.cumsum(self.bytes_of[flat])
        return flat, np.concatenate(([0], np.searchsorted(passed, np.cumsum(sizes), side="left") + 1))

    def _learn(self, data, starts, ends, inner, keys, checks) -> None:
        for part, encode in ((inner, True), (~inner, False)):
            at = np.flatnonzero(part)
            if not len(at):
                continue
            if encode:
                flat, offsets = self._joined(data, starts[at], ends[at])
            else:
                sizes = ends[at] - starts[at]
                own = np.concatenate([data[a:b] for a, b in zip(starts[at], ends[at])])
                flat, offsets = self.whole(own, np.concatenate(([0], np.cumsum(sizes))))
            place = len(self.ends) - 1 + np.arange(len(at))
            self.ends = np.concatenate((self.ends, len(self.ids) + offsets[1:]))
            self.ids = np.concatenate((self.ids, flat))
            order = np.argsort(keys[at], kind="stable")
            to = np.searchsorted(self.keys, keys[at][order])
            self.keys = np.insert(self.keys, to, keys[at][order])
            self.checks = np.insert(self.checks, to, checks[at][order])
            self.places = np.insert(self.places, to, place[order])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in ``self.keys``, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts in ``data`` and n + 1 offsets by text, without end ids."""
        if not self.segments or not len(data):
            return self.whole(data, offsets)
        if len(self.keys) > CACHED_SEGMENTS:
            self._clear()
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        start, cut = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
        cut[_cuts(data)] = True
        cut[full] = False
        start |= cut[:-1]
        start[full] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        key, check = self.hasher.ranges(data, starts, ends), _tails(data, starts, ends)
        first, inverse = distinct(key)
        wanted = key[first]
        new = first[self._find(wanted) < 0]
        inner = cut[starts[new]] & cut[ends[new]]
        self._learn(data, starts[new], ends[new], inner, key[new], check[new])
        at = self._find(wanted)[inverse]
        if not np.array_equal(self.checks[at], check):  # two segments share a hash
            self._clear()
            return self.whole(data, offsets)
        place = self.places[at]
        begins = self.ends[place]
        sizes = self.ends[place + 1] - begins
        sums = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.repeat(begins - sums[:-1], sizes) + np.arange(sums[-1])]
        return flat, sums[np.searchsorted(starts, offsets, side="left")]

    def documents(self, data: np.ndarray, offsets: np.ndarray, step: int = 2 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Row number and ids with the end id of every text; about ``step`` bytes are encoded at a time."""
        for low, high in slices(offsets, step):
            part = data[offsets[low] : offsets[high]]
            flat, at = self.encode(part, offsets[low : high + 1] - offsets[low])
            flat = flat.astype("<u4")
            end = np.array([END_ID], "<u4")
            for i in range(high - low):
                yield low + i, np.concatenate((flat[at[i] : at[i + 1]], end))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def ids_list(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))


def worker_encoder(path: str | None) -> Encoder:
    return worker_state(f"encoder {path}", lambda: Encoder(path))
