"""BPE encoding and decoding with a deterministic automaton over the tokens.

The automaton accepts exactly the token sequences that the merges, applied in order of rank, can
leave.  It begins with one state that every base symbol leads back to.  Each merge u + v -> m then
adds a gadget: the state behind u gets a copy of its own without the arc v (so u, v can't follow one
another any more), and wherever u may be read, m may be read too and leads where v led.  What may
follow a token depends on the token alone, so a state is named by a row of the table `allowed` and an
arc by a column; both are then merged where equal.

A prefix of a word has one sequence that the automaton accepts.  Encoding goes along a word and keeps, for
each position, the state and the last token.  A trie gives the tokens that begin at each position which
has a state, so a symbol is looked at once for each token that it may lie in; of those that end at a
position one is right, that for which the state at its first symbol has an arc.  All steps are table
look-ups, for many words at once.  Decoding emits the labels of the arcs, a space between them, as the
library does for a file without a decoder; a file that has one is refused.

Texts are split by the pattern of the vocabulary file; plain chunks by the same pattern here, all
others (rare scripts, marks, control characters, strings of special tokens) by the library's own
normalizer and splitter.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from loomwright.llm.encode import ChunkEncoder, byte_symbols, plain_splitter


@dataclass
class Automaton:
    """labels: the string of each id; special: ids of added tokens by string.

    Symbols are bytes 0..255 inside a word and 256..511 as its last byte.  Trie: node t of symbol s has
    its child at base[t] + s if check there is t; token_of gives a node's id or -1.
    allowed: bits, a row for each state and a column for each class of tokens.
    """

    labels: list[str]
    special: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    token_of: np.ndarray
    column: np.ndarray
    target: np.ndarray
    allowed: np.ndarray
    spec: str

    def dumps(self) -> bytes:
        return zlib.compress(pickle.dumps(self.__dict__), 1)

    @staticmethod
    def loads(data: bytes) -> Automaton:
        return Automaton(**pickle.loads(zlib.decompress(data)))


def gadgets(n_tokens: int, base_tokens: list[int], merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """allowed (state x class of tokens, bytes 0 or 1), each token's class, and the state it leads to.
    Tokens share a column until an arc of one of them is taken away."""
    allowed = np.zeros((4096, 1024), np.uint8)
    allowed[0, 0] = 1
    column = np.full(n_tokens, 1, np.int32)  # class 1: no arcs
    column[base_tokens] = 0
    sharing = [len(base_tokens), n_tokens]
    target = np.zeros(n_tokens, np.int32)
    states = 1
    own: set[int] = set()  # tokens whose state no other token leads to
    for u, v, m in merges:
        q, r = int(target[u]), int(target[v])
        if not allowed[q, column[v]]:
            raise ValueError(f"merge {u} + {v} can't be reached")
        if u not in own or u == v:
            if states == len(allowed):
                allowed = np.concatenate([allowed, np.zeros_like(allowed)])
            allowed[states] = allowed[q]
            target[u], q = states, states
            own.add(u)
            states += 1
        if sharing[column[v]] > 1:
            if len(sharing) == allowed.shape[1]:
                allowed = np.concatenate([allowed, np.zeros((len(allowed), 1024), np.uint8)], axis=1)
            allowed[:, len(sharing)] = allowed[:, column[v]]
            sharing[column[v]] -= 1
            column[v] = len(sharing)
            sharing.append(1)
        allowed[q, column[v]] = 0
        column[m], target[m] = column[u], r
        sharing[column[u]] += 1
        if r:
            own.discard(v)  # v and m share that state from now on
    # states that no token leads to are left out; state 0, the beginning, stays first
    kept, place = np.unique(np.append(target, 0), return_inverse=True)
    return allowed[kept, : len(sharing)], column, place[:-1].astype(np.int32)


def double_array(strings: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie of the tokens' symbols as base, check and token_of."""
    children: list[dict[int, int]] = [{}]
    token = [-1]
    for t, s in strings.items():
        node = 0
        for c in s:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                token.append(-1)
            node = children[node][c]
        token[node] = t
    # rows of the trie, most children first, go to the first place where they fit
    size = len(children) + 4096
    check, base, place = np.full(size, -1, np.int32), np.zeros(size, np.int32), {0: 0}
    free = np.ones(size, bool)
    free[0] = False
    token_of = np.full(size, -1, np.int32)
    low, todo = 1, [0]
    while todo:
        nxt = []
        for node in sorted(todo, key=lambda x: -len(children[x])):
            own = children[node]
            if not own:
                continue
            symbols = np.array(sorted(own))
            spots = np.flatnonzero(free[low:]) + low
            for at in range(0, len(spots), 512):
                some = spots[at : at + 512] - symbols[0]
                some = some[some >= 0]
                some = some[some + 512 < len(free)]
                fits = free[some[:, None] + symbols].all(1) if len(some) else np.zeros(0, bool)
                if fits.any():
                    b = int(some[fits.argmax()])
                    break
            else:
                b = len(free)
                grow = 4096
                free = np.concatenate([free, np.ones(grow, bool)])
                check, token_of = (np.concatenate([x, np.full(grow, -1, np.int32)]) for x in (check, token_of))
                base = np.concatenate([base, np.zeros(grow, np.int32)])
            base[place[node]] = b
            for c, child in own.items():
                place[child] = b + c
                check[b + c], token_of[b + c], free[b + c] = place[node], token[child], False
                nxt.append(child)
            while low < len(free) and not free[low]:
                low += 1
        todo = nxt
    grow = 1024
    return (np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([token_of, np.full(grow, -1, np.int32)]))


def compile_automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file with merges and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder"):
        raise ValueError(f"{path}: a decoder of type {spec['decoder'].get('type')}: labels are joined by spaces only")
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    symbols = byte_symbols()
    number = {c: b for b, c in enumerate(symbols)}
    strings = {t: tuple(number[c] + 256 * (w and i == len(x) - 1) for i, c in enumerate(x)) for s, t in vocab.items() for w in [s.endswith(end) and len(s) > len(end)] for x in [s[: -len(end)] if w else s]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[(a + b)]) for a, b in pairs]
    n = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
    bases = [vocab[s] for s in symbols] + [vocab[s + end] for s in symbols]
    allowed, column, target = gadgets(n, bases, merges)
    # equal columns and equal rows become one
    bits = np.packbits(allowed, axis=0)
    _, first, group = np.unique(np.ascontiguousarray(bits.T).view(f"V{bits.shape[0]}").ravel(), return_index=True, return_inverse=True)
    column = group[column]
    table = np.packbits(allowed[:, first], axis=1, bitorder="little")
    _, keep, row = np.unique(np.ascontiguousarray(table).view(f"V{table.shape[1]}").ravel(), return_index=True, return_inverse=True)
    labels = [""] * n
    for s, t in vocab.items():
        labels[t] = s
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    for s, t in special.items():
        labels[t] = s
    return Automaton(labels, special, *double_array(strings), column.astype(np.int32), np.append(row[target], row[0]).astype(np.int32), table[keep], json.dumps({k: spec[k] for k in ("normalizer", "pre_tokenizer")}))


#: Words longer than this are encoded one at a time.
LONG_WORD = 48


def encode_words(a: Automaton, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each has."""
    sizes = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # word, ids
    order = np.argsort(sizes, kind="stable")
    out: list[np.ndarray | None] = [None] * len(words)
    short = order[(sizes[order] <= LONG_WORD) & (sizes[order] > 0)]
    for at in range(0, len(short), 1 << 14):
        part = short[at : at + (1 << 14)]
        ids, n = _many(a, [words[i] for i in part.tolist()], sizes[part])
        counts[part] = n
        found.append((part, ids))
    for i in order[sizes[order] > LONG_WORD].tolist():
        ids = _one(a, words[i])
        out[i] = ids
        counts[i] = len(ids)
    ends = np.cumsum(counts)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    for part, ids in found:
        n = counts[part]
        local = np.cumsum(n)
        flat[np.repeat((ends - counts)[part] - (local - n), n) + np.arange(len(ids))] = ids
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        flat[ends[i] - counts[i] : ends[i]] = out[i]
    return flat, counts


def _many(a: Automaton, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width = len(words), int(sizes.max())
    chars = np.zeros((width, n), np.int32)
    raw = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(raw)) - np.repeat(starts, sizes)
    chars[inside, np.repeat(np.arange(n), sizes)] = raw
    chars[sizes - 1, np.arange(n)] += 256
    state = np.full((width + 1, n), -1, np.int32)
    state[0] = a.target[-1]
    token = np.full((width + 1, n), -1, np.int32)
    back = np.zeros((width + 1, n), np.int32)
    word = np.zeros(0, np.int64)  # live starts: their word, first position and trie node
    start = np.zeros(0, np.int32)
    node = np.zeros(0, np.int64)
    first = 0  # words are sorted by length: those that have ended come first
    for i in range(width):
        while first < n and sizes[first] <= i:
            first += 1
        fresh = np.arange(first, n)
        fresh = fresh[state[i, fresh] >= 0]
        live = word >= first
        word = np.concatenate([word[live], fresh])
        start = np.concatenate([start[live], np.full(len(fresh), i, np.int32)])
        node = np.concatenate([node[live], np.zeros(len(fresh), np.int64)])
        child = a.base[node] + chars[i, word]
        ok = a.check[child] == node
        word, start, node = word[ok], start[ok], child[ok].astype(np.int64)
        t = a.token_of[node]
        has = np.flatnonzero(t >= 0)
        t, w, s = t[has], word[has], start[has]
        col = a.column[t]
        right = (a.allowed[state[s, w], col >> 3] >> (col & 7)) & 1 == 1
        t, w, s = t[right], w[right], s[right]
        state[i + 1, w], token[i + 1, w], back[i + 1, w] = a.target[t], t, s
    # from the end of each word to its front
    at, all_words = sizes.copy(), np.arange(n)
    steps_w, steps_t = [], []
    while len(all_words):
        t = token[at[all_words], all_words]
        if (t < 0).any():
            raise ValueError("a word has no path through the automaton")
        steps_w.append(all_words)
        steps_t.append(t)
        at[all_words] = back[at[all_words], all_words]
        all_words = all_words[at[all_words] > 0]
    w, t = np.concatenate(steps_w[::-1]), np.concatenate(steps_t[::-1])
    by_word = np.argsort(w, kind="stable")
    return t[by_word].astype(np.uint32), np.bincount(w, minlength=n)


def _one(a: Automaton, word: bytes) -> np.ndarray:
    n = len(word)
    chars = [*word[:-1], word[-1] + 256]
    base, check, token_of, allowed, column, target = a.base, a.check, a.token_of, a.allowed, a.column, a.target
    state, token, back = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    state[0] = int(target[-1])
    for s in range(n):
        q = state[s]
        if q < 0:
            continue
        node, row = 0, allowed[q]
        for i in range(s, n):
            child = int(base[node]) + chars[i]
            if check[child] != node:
                break
            node = child
            t = int(token_of[node])
            if t >= 0:
                c = int(column[t])
                if row[c >> 3] >> (c & 7) & 1:
                    state[i + 1], token[i + 1], back[i + 1] = int(target[t]), t, s
    ids, at = [], n
    while at:
        ids.append(token[at])
        at = back[at]
    return np.array(ids[::-1], np.uint32)


def automaton_encoder(a: Automaton) -> ChunkEncoder:
    """A chunk encoder whose words go through the automaton."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    shell = Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None, **json.loads(a.spec), "model": json.loads(Tokenizer(BPE()).to_str())["model"]}))
    lower = shell.normalizer.normalize_str("AZ") == "az"
    split = plain_splitter(json.loads(a.spec), lower)
    special = re.compile("(" + "|".join(map(re.escape, sorted(a.special, key=len, reverse=True))) + ")") if a.special else None
    to_byte = {c: b for b, c in enumerate(byte_symbols())}

    def pieces(chunk: str) -> list[bytes | int]:
        out: list[bytes | int] = []
        for part in special.split(chunk) if special else [chunk]:
            if part in a.special:
                out.append(a.special[part])
            elif part:
                out += [bytes(to_byte[c] for c in x) for x, _ in shell.pre_tokenizer.pre_tokenize_str(shell.normalizer.normalize_str(part))]
        return out

    def encode_chunks(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        exact: list[tuple[int, int]] = []  # places of special tokens
        sizes = []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            own: list[bytes | int] = [x.encode() for x in split(text) or []]
            if not own:
                own = pieces(text)
                for k, x in enumerate(own):
                    if isinstance(x, int):
                        exact.append((len(words) + k, x))
                        own[k] = b"!"
            words += own
            sizes.append(len(own))
        ids, counts = encode_words(a, words)
        first = np.cumsum(counts) - counts
        for place, t in exact:
            ids[first[place]] = t
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return ids, np.diff(ends, prepend=0)

    return ChunkEncoder(encode_chunks, fold=lower)


class Decoder:
    """Labels of the arcs, a space between them: what a file without decoder gives."""

    def __init__(self, a: Automaton):
        self.labels = [s.encode() for s in a.labels]

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.labels.__getitem__, ids.tolist()))


_COMPILED: dict[str, bytes] = {}


def compiled(path: str) -> bytes:
    """The automaton's bytes, made once in a process; some MB, whatever the data."""
    if path not in _COMPILED:
        _COMPILED[path] = compile_automaton(path).dumps()
    return _COMPILED[path]


def encode_all(a: Automaton, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    return automaton_encoder(a).encode(texts)
