"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

The library is asked once for each distinct chunk that a Python worker meets: a text is
cut where no token can cross, so the ids of the text are the ids of its chunks, joined.

* ``word`` files (white space dropped): cut at every space and line feed.
* ``byte`` files (byte-level, a space belongs to the word after it): cut before a space
  that has a character other than white space on either side.

New chunks of Latin-1 characters are cut further by the file's own word pattern, and the
library's model gets the distinct pieces; all other chunks go through the whole tokenizer.  A file whose
normaliser or pre-tokeniser is not one of the two above is not cut at all: the library gets its whole texts.

What a worker remembers is bounded in bytes and only saves time: chunks and their ids lie in flat
arrays, found by hash and compared byte for byte, in two generations.  When the young one is
full it becomes the old one, and chunks found in the old one move to the young one, so frequent chunks stay.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from parcelwise.llm.common import word_hash

# The word patterns of the two tokenizer files, and their normaliser and pre-tokeniser.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = {
    "byte": {"normalizer": None,
             "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    "word": {"normalizer": {"type": "Sequence", "normalizers": [
                 {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
             "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                 {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
                 {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}},
}

_CUT = {"word": re.compile(r"[ \n]+"), "byte": re.compile(r" (?=\S)(?<=\S )")}
_PIECES = {"word": regex.compile(WORD_PATTERN), "byte": regex.compile(BYTE_PATTERN)}
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0]")     # white space of Latin-1 besides space and line feed
PUNCTUATION = frozenset(".,;:!?")
IDS = pa.list_(pa.uint32())


class Generation:
    """Chunks and their ids in flat arrays, found by hash."""

    def __init__(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chunks, self.ids = pa.array([], pa.string()), pa.array([], IDS)

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.rows.nbytes + self.chunks.nbytes + self.ids.nbytes

    def find(self, hashes: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """The row of each chunk, -1 where it is not here."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        row = np.where(self.hashes[at] == hashes, self.rows[at], -1)
        hit = np.flatnonzero(row >= 0)
        same = pc.equal(self.chunks.take(pa.array(row[hit])), chunks.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        row[hit[~same]] = -1
        return row

    def add(self, hashes: np.ndarray, chunks: pa.Array, ids: pa.ListArray) -> None:
        if not len(hashes):
            return
        rows = np.r_[self.rows, np.arange(len(self.chunks), len(self.chunks) + len(hashes))]
        hashes = np.r_[self.hashes, hashes]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows = hashes[order], rows[order]
        self.chunks, self.ids = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.ids, ids])


class Memory:
    """Two generations of at most ``most`` bytes each."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, Generation(), Generation()

    def ids(self, chunks: pa.Array, learn) -> pa.ListArray:
        """The ids of distinct chunks; ``learn`` gives those of chunks that are not remembered."""
        hashes = word_hash(chunks)
        place, parts, base = np.full(len(chunks), -1), [], 0

        def settle(at: np.ndarray, ids: pa.ListArray) -> None:
            nonlocal base
            place[at] = base + np.arange(len(at))
            base += len(at)
            parts.append(ids)

        row = self.young.find(hashes, chunks)
        settle(np.flatnonzero(row >= 0), self.young.ids.take(pa.array(row[row >= 0])))
        left = np.flatnonzero(place < 0)
        row = self.old.find(hashes[left], chunks.take(pa.array(left)))
        again, new = left[row >= 0], left[row < 0]
        settle(again, self.old.ids.take(pa.array(row[row >= 0])))
        settle(new, lists(learn(chunks.take(pa.array(new)).to_pylist())))
        fresh = np.r_[again, new]
        self.young.add(hashes[fresh], chunks.take(pa.array(fresh)), pa.concat_arrays(parts[1:]))
        if self.young.nbytes > self.most:
            self.young, self.old = Generation(), self.young
        return pa.concat_arrays(parts).take(pa.array(place))


def lists(raw: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    ends = np.cumsum([0, *map(len, raw)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4"), pa.uint32()))


class ChunkEncoder:
    def __init__(self, path: str, kind: str, remembered: int = 32 << 20):
        """``remembered``: bytes of a generation of chunks (memory and time only)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.kind = kind
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)        # for pieces that are already normalised and cut
        parts = json.loads(self.model.to_str())
        self.cuts = all(parts.get(k) == v for k, v in KNOWN[kind].items()) and parts["model"]["type"] == "BPE"
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocab = self.whole.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():   # byte-level: one character stands for one byte
            self.token_bytes[i] = len(token.removesuffix("</w>") if kind == "word" else token)
        self.lead = " " if kind == "byte" else ""     # stands before every chunk but the first
        self.known = Memory(remembered)
        self.first = Memory(remembered // 8) if self.lead else self.known     # chunks without the lead

    def _plain(self, chunk: str) -> bool:
        return (chunk.isascii() or max(chunk) < "Ā") and ("<" not in chunk or not any(s in chunk for s in self.special))

    def _model_ids(self, pieces: list[str]) -> list[bytes]:
        """The model's ids of each piece, found by the bytes they stand for."""
        ids = np.array(self.model.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        stops = np.cumsum(self.token_bytes[ids])
        wanted = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        cuts = np.searchsorted(stops, wanted) + 1
        if len(stops) == 0 or stops[-1] != wanted[-1] or not np.array_equal(stops[cuts - 1], wanted):
            raise ValueError("the tokenizer file leaves characters out")
        raw = ids.astype("<u4").tobytes()
        ends = (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _learn(self, new: list[str], lead: str, plain: bool) -> list[bytes]:
        """The ids of the chunks, each with ``lead`` before it; ``plain``: all are known to be."""
        find, lower = _PIECES[self.kind].findall, self.kind == "word"
        cut: list[tuple[str, ...] | None] = []        # pieces of each chunk; None: the whole tokenizer has to
        for c in new:
            if not c or not (plain or self._plain(c)):
                cut.append(None)
                continue
            t = c.lower() if lower else c
            if t.isalpha():
                cut.append((lead + t,))
            elif t[-1] in PUNCTUATION and t[:-1].isalpha():
                cut.append((lead + t[:-1], t[-1]))
            else:
                cut.append(tuple(find(lead + t)))
        wanted, ids = list({p for ps in cut if ps for p in ps}), {}
        for at in range(0, len(wanted), 5000):
            part = wanted[at:at + 5000]
            ids.update(zip(part, self._model_ids(part)))
        whole = iter(self.whole.encode_batch_fast([lead + c for c, ps in zip(new, cut) if ps is None], add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4").tobytes() if ps is None else ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
                for ps in cut]

    def _ids(self, chunks: pa.Array, lead: str, plain: bool = False) -> pa.ListArray:
        """The ids of distinct chunks, each with ``lead`` before it."""
        return (self.known if lead == self.lead else self.first).ids(chunks, lambda new: self._learn(new, lead, plain))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [_CUT[self.kind].split(t) for t in texts]
        out, ends = self._joined([c[0] for c in cut], [c[1:] for c in cut], plain=False)
        return [out[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _joined(self, heads: list[str], tails: list[list[str]], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        words = pa.array([w for tail in tails for w in tail], pa.string()).dictionary_encode()
        sizes = np.array([len(tail) for tail in tails], np.int64)
        return self._assembled(heads, words.dictionary, words.indices.to_numpy(), sizes, plain)

    def _assembled(self, heads: list[str], distinct: pa.Array, tails: np.ndarray, sizes: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, each a head and its ``sizes`` tails (numbers into ``distinct``), and where each text's begin (and the last ends)."""
        first = pa.array(heads, pa.string()).dictionary_encode()
        blocks = pa.concat_arrays([self._ids(distinct, self.lead, plain), self._ids(first.dictionary, "", plain)])
        at = np.cumsum(sizes + 1) - (sizes + 1)
        which = np.empty(int(sizes.sum()) + len(heads), np.int64)
        tail = np.ones(len(which), bool)
        tail[at] = False
        which[at], which[tail] = first.indices.to_numpy().astype(np.int64) + len(distinct), tails
        flat = blocks.take(pa.array(which))
        return flat.values.to_numpy(), np.r_[flat.offsets.to_numpy()[at], len(flat.values)]

    def _regular(self, text: str) -> bool:
        """Whether the spaces of the text (Latin-1 only) are the cuts: for ``byte`` files each between other characters."""
        if not self.cuts:
            return False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        if "<" in text and any(s in text for s in self.special):
            return False
        if self.kind == "word":
            return True
        return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text))

    def _regular_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular texts: Arrow cuts the words and numbers the distinct ones."""
        if self.kind == "word":
            texts = [t.lower().replace("\n", " ") for t in texts]
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at = cut.offsets.to_numpy()[:-1]
        words = cut.values.dictionary_encode()
        which = np.delete(words.indices.to_numpy(), at)
        return self._assembled([t.partition(" ")[0] for t in texts], words.dictionary, which, np.diff(cut.offsets.to_numpy()) - 1, plain=True)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column one after another (null: empty), and where each text's begin (and the last ends)."""
        texts = [t or "" for t in column.to_pylist()]
        regular = [self._regular(t) for t in texts]
        if all(regular):
            return self._regular_ids(texts)
        ids, ends = self._regular_ids([t for t, r in zip(texts, regular) if r] or [""])
        rest = iter(self.encode([t for t, r in zip(texts, regular) if not r]))
        spans = iter(zip(ends[:-1].tolist(), ends[1:].tolist()))
        parts = [ids[slice(*next(spans))] if r else np.frombuffer(next(rest), "<u4") for r in regular]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, remembered: int = 32 << 20) -> ChunkEncoder:
    """The worker's encoder of a file."""
    return ChunkEncoder(path, kind, remembered)
