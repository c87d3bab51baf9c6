"""Byte-level BPE of whole texts with the tokenizers library, with a cache of words.

A byte-level pre-tokenizer never joins characters across a single space (or line end) between two
others that are not white space, so the ids of a text are those of its words in turn.  Words are
found and hashed to 64 bits for a whole batch of texts with numpy; those that the cache lacks go to
the tokenizer.  Texts with any other white space are encoded whole.  So are all texts if the file
asks for something else than plain byte-level BPE."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Words that a worker keeps, about 40 bytes each; bytes of text whose words are hashed at once.
CACHE, CHUNK = 3_000_000, 1 << 22
#: Bytes of the longest word that is hashed.
LONGEST = 4096
_LONE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ")
#: Bytes with which other white space, and much else, begins.
_MAYBE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")
_OTHER = re.compile(r"[^\S \n]")
_rng = np.random.Generator(np.random.PCG64(6))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPOT = _rng.integers(0, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: After a letter, a run of these is tokens of its own in byte-level BPE.
_TAIL = '.,!?;:$%&*#|"()[]'


def _odd(text: str, data: bytes) -> bool:
    """True if anything but single spaces and line ends separates the words, or a word is too long."""
    if data[0] in b" \n" or data[-1] in b" \n" or any(x in data for x in _PAIRS) or len(data.translate(None, _LONE)) < len(data):
        return True
    if any(x in data for x in _MAYBE) and _OTHER.search(text):
        return True
    return len(data) > LONGEST and max(map(len, data.split())) > LONGEST - 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(path: str | None) -> str:
    """The type that holds every id of a vocabulary file, without loading its tokenizer."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["id"] for t in spec.get("added_tokens", [])]
    vocabulary = spec["model"]["vocab"]
    ids = vocabulary.values() if isinstance(vocabulary, dict) else [len(vocabulary)]
    return "<u2" if max([*ids, *added], default=0) < 1 << 16 else "<u4"


def _hashes(joined: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and hashes of the words that begin at the places at."""
    raw = np.frombuffer(joined, np.uint8)
    ends = np.append(at[1:], len(raw))
    spot = np.arange(len(raw)) - np.repeat(at, ends - at)
    hashes = np.add.reduceat(_BYTE[raw] * _SPOT[spot], at)
    return ends, hashes ^ (hashes >> np.uint64(31))


class Encoder:
    """encode(texts) gives each text's ids as little-endian bytes of self.dtype."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(id_type(path))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = self.by_word and not any(re.search(r"\s", t) for t in added)
        self.line_end = self._plain(["\n"])[0] if self.by_word else b""
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, self.dtype), 0

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 where there is none."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.rows[at], -1) if len(self.hashes) else np.full(len(hashes), -1)

    def _add(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.array([len(x) for x in parts], np.int64) // self.dtype.itemsize
        n = len(parts)
        while self.n + n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.sizes[self.n : self.n + n] = sizes
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.rows = np.insert(self.rows, at, (self.n + order).astype(np.int32))
        self.n, self.used = self.n + n, self.used + len(flat)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words; the first character says what comes before: a space, a line end, or a tab for
        the start of the text.  After a letter, a tail of signs has ids of its own."""
        keys = []
        for w in words:
            key = w if w[0] != "\n" else "\t" + w[1:]
            core = key.rstrip(_TAIL)
            cut = 1 < len(core) < len(key) and core[-1].isalpha() and core[-1] < "\u0250"
            keys.append((core, "\t" + key[len(core) :]) if cut else (key, "\t"))
        stems = list({k for pair in keys for k in pair})
        _, marks = _hashes("".join(stems).encode(), np.cumsum([0, *[len(k.encode()) for k in stems[:-1]]]))
        rows = self._find(marks)
        known = {}
        for k, r in zip(stems, rows.tolist(), strict=True):
            if r >= 0:
                known[k] = self.ids[self.starts[r] : self.starts[r] + self.sizes[r]].tobytes()
        lacking = [i for i, k in enumerate(stems) if k not in known]
        fresh = self._plain([stems[i].removeprefix("\t") for i in lacking])
        known.update(zip((stems[i] for i in lacking), fresh, strict=True))
        self._add(marks[lacking], fresh)
        left = [i for i, (w, (core, tail)) in enumerate(zip(words, keys, strict=True)) if w != core or tail != "\t"]
        self._add(hashes[left], [(self.line_end if words[i][0] == "\n" else b"") + known[keys[i][0]] + known[keys[i][1]] for i in left])

    def _by_word(self, datas: list[bytes]) -> list[bytes]:
        joined = b"\t" + b"\t".join(datas)
        raw = np.frombuffer(joined, np.uint8)
        at = np.flatnonzero((raw == 32) | (raw == 10) | (raw == 9))
        ends, hashes = _hashes(joined, at)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n > CACHE:
            self._clear()
        rows = self._find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn(distinct[new], [joined[a:b].decode() for a, b in zip(at[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            rows = self._find(distinct)
        starts, sizes = self.starts[rows][inverse], self.sizes[rows][inverse].astype(np.int64)
        stops = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1])]
        begins = (stops - sizes)[raw[at] == 9].tolist()
        return [ids[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        out: list[bytes] = [b""] * len(texts)
        words, datas, whole = [], [], []
        for i, text in enumerate(texts):
            if text:
                data = text.encode()
                if _odd(text, data):
                    whole.append(i)
                else:
                    words.append(i)
                    datas.append(data)
        low = 0
        while low < len(words):  # whole texts, CHUNK bytes of them at a time
            high, held = low, 0
            while high < len(words) and (high == low or held + len(datas[high]) <= CHUNK):
                held += len(datas[high])
                high += 1
            for i, ids in zip(words[low:high], self._by_word(datas[low:high]), strict=True):
                out[i] = ids
            low = high
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder per worker and path; None stands for the public byte-level vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path or default_path())
