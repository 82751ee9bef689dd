"""Encoding whole documents through a cache of white-space-delimited chunks.

No pattern of the tokenizer and no normalization step reaches across ASCII white space, so the ids
of a text are the ids of its chunks in order.  Only distinct chunks are therefore encoded; the rest
is table look-up and one gather.  The cache is bounded: chunks beyond the bound are encoded again
whenever a batch holds them, which costs time and changes nothing.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

#: Words handled at once, bytes of one text handled at once, chunks remembered by one encoder.
BATCH_WORDS, BLOCK_BYTES, CACHE_CHUNKS = 200_000, 1 << 20, 300_000

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def default_vocabulary() -> str:
    """The path of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def folded(text: bytes) -> bytes:
    """The text with A-Z in lower case where the tokenizer's own lower-casing can't tell: not beside
    the strings of special tokens, nor beside marks that compose with a small letter alone."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that end at white space."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class ChunkEncoder:
    """encode_chunks: distinct chunks in, (all ids one after another, how many each chunk has) out."""

    def __init__(self, encode_chunks: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_CHUNKS, fold: bool = True):
        self.encode_chunks, self.limit, self.fold = encode_chunks, limit, fold
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, chunks: int, ids: int) -> None:
        n = len(self.known)
        if n + chunks > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(n + chunks, np.int64)]) for x in (self.start, self.count))
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + ids, np.uint32)])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        at = np.array(list(map(self.known.get, words, repeat(-1))), np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = dict.fromkeys(words[i] for i in missing.tolist())
            ids, counts = self.encode_chunks(list(fresh))
            n = len(self.known)
            self._room(len(fresh), len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(fresh)] = self.used + np.cumsum(counts) - counts
            self.count[n : n + len(fresh)] = counts
            for k, w in enumerate(fresh):
                fresh[w] = n + k
            at[missing] = [fresh[words[i]] for i in missing.tolist()]
            if n + len(fresh) <= self.limit:
                self.known.update(fresh)
                self.used += len(ids)
        counts = self.count[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[at] - (ends - counts), counts)
        take += np.arange(total)
        return self.ids[take], counts

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text as an array of unsigned 32-bit integers, in order; null is empty."""
        words: list[bytes] = []
        sizes: list[int] = []
        for text in texts:
            text = text or b""
            if self.fold:
                text = folded(text)
            if len(text) > BLOCK_BYTES:
                yield from self._flush(words, sizes)
                words, sizes = [], []
                yield np.concatenate([self._words(w)[0] for b in blocks(text) if (w := b.split())] or [np.zeros(0, np.uint32)])
                continue
            own = text.split()
            words += own
            sizes.append(len(own))
            if len(words) >= BATCH_WORDS:
                yield from self._flush(words, sizes)
                words, sizes = [], []
        yield from self._flush(words, sizes)

    def _flush(self, words: list[bytes], sizes: list[int]) -> Iterator[np.ndarray]:
        if not sizes:
            return
        ids, counts = self._words(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        at = 0
        for end in ends.tolist():
            yield ids[at:end]
            at = end


#: Chunks of these characters only change by lower-casing.
PLAIN_CHUNK = "[!-~¡-¬®-ɏ]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from U+0100."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def plain_splitter(spec: dict, lower: bool) -> Callable[[str], list[str] | None]:
    """Splits a plain chunk by the vocabulary file's own pattern; None for any other chunk, and for all
    if the file splits in another way than by one pattern and bytes."""
    import regex

    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split"]
    if len(patterns) != 1 or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not lower:
        return lambda chunk: None
    split, plain = regex.compile(patterns[0]).findall, regex.compile(PLAIN_CHUNK).fullmatch
    if split("a1,b'x") != ["a", "1", ",", "b", "'", "x"]:
        return lambda chunk: None

    def pieces(chunk: str) -> list[str] | None:
        """Most chunks are letters, or letters and one mark: the pattern is asked for the others only."""
        if not (chunk.isascii() and chunk.isprintable() or plain(chunk)) or "<|" in chunk:
            return None
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return split(chunk)

    return pieces


_LIBRARY: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """An encoder of this process whose chunks the tokenizers library encodes: the words of plain chunks
    by the file's model, which is all that is left to do for them, other chunks by the whole tokenizer."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lower = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        split, model, symbols = plain_splitter(spec, lower), tokenizer.model, dict(enumerate(byte_symbols()))

        def encode_chunks(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            out: list[list[int] | None] = []
            words: dict[str, list[int]] = {}
            for chunk in chunks:
                own = split(chunk.decode("utf-8", "replace"))
                if own is None:
                    out.append(None)
                    continue
                ids: list[int] = []
                for w in own:
                    got = words.get(w)
                    if got is None:
                        x = w if w.isascii() else w.encode().decode("latin-1").translate(symbols)
                        got = words[w] = [t.id for t in model.tokenize(x)]
                    ids += got
                out.append(ids)
            rest = [k for k, x in enumerate(out) if x is None]
            for at in range(0, len(rest), 4096):
                part = rest[at : at + 4096]
                e = tokenizer.encode([chunks[k].decode("utf-8", "replace") for k in part], is_pretokenized=True, add_special_tokens=False)
                ids, ends = e.ids, np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))).tolist()
                for k, a, b in zip(part, [0, *ends], ends):
                    out[k] = ids[a:b]
            return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

        _LIBRARY[path] = ChunkEncoder(encode_chunks, fold=lower)
    return _LIBRARY[path]
