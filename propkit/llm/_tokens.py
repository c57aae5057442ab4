"""Token ids of whole texts in Arrow tasks: byte-level BPE through a cache of chunks."""

from __future__ import annotations

import json

import numpy as np

from propkit.llm import _text as T

CACHE_CHUNKS = 1 << 18  # distinct chunks remembered by a worker (some 20 MB); beyond it the cache starts anew
TOKENIZE_BYTES = 4 << 20
ALNUM, PUNCT = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCT[33:127] = ~ALNUM[33:127]


class ChunkTokenizer:
    """Ids of whole texts through a cache of chunks.

    The vocabulary's pre-tokenisation pattern never lets a token run across the places
    where ``chunk_starts`` cuts, so ids of the chunks are the ids of the text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            cut = json.load(f)["pre_tokenizer"] or {}
        if (cut.get("type"), cut.get("use_regex", True), cut.get("add_prefix_space", False)) != ("ByteLevel", True, False):
            raise ValueError(f"{path}: only the byte-level pre-tokeniser without a prefix space is supported, not {cut}")
        tok = Tokenizer.from_file(path)
        vocab, special = tok.get_vocab(with_added_tokens=False), {a.content for a in tok.get_added_tokens_decoder().values()}
        # the printable stand-ins of the byte alphabet, in the order of the bytes they stand for
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert set(byte) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        # fixed value: the pattern of the byte-level pre-tokeniser
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line = self.enc.encode_ordinary("\n")[0]
        self.reset()

    def reset(self) -> None:
        # an open-addressing table from chunk hash to entry; 0 marks a free place
        self.table, self.entry = np.zeros(2 * CACHE_CHUNKS, np.uint64), np.zeros(2 * CACHE_CHUNKS, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        # the bytes of every entry, which a chunk is compared with before it takes the entry's ids
        self.raw, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of the hashes, -1 where unknown."""
        mask = np.uint64(len(self.table) - 1)
        out = np.full(len(h), -1, np.int64)
        at = (h & mask).astype(np.int64)
        got = self.table[at]
        hit = got == h
        out[hit] = self.entry[at[hit]]
        open_ = np.flatnonzero(~hit & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            got = self.table[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.entry[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.table) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.table[at[todo]] == 0
            t = todo[free]
            self.table[at[t]] = h[t]  # of several, the last one has the place
            won = self.table[at[t]] == h[t]
            self.entry[at[t[won]]] = entry[t[won]]
            todo = np.concatenate([todo[~free], t[~won]])
            at[todo] = (at[todo] + 1) & mask

    def _same(self, entry: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whether the chunks ``buf[s:e]`` are the bytes of their entries."""
        same = self.size[entry] == e - s
        i = np.flatnonzero(same)
        if len(i):
            mine, _, first = T.lanes(buf, s[i], e[i])
            theirs, _, _ = T.lanes(self.raw, self.at[entry[i]], self.at[entry[i]] + self.size[entry[i]])
            same[i] = np.logical_and.reduceat(mine == theirs, first)
        return same

    def _learn(self, new: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray, known: bool = True) -> np.ndarray:
        """Add the chunks ``buf[s:e]`` with the distinct hashes ``new``, to be found by them if
        ``known``; the entries."""
        size = e - s
        self.at = np.append(self.at, len(self.raw) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        take = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.raw = np.concatenate([self.raw, buf[take]])
        odd = np.concatenate(([0], np.cumsum(buf <= 0x20)))
        lone = odd[e] - odd[s] == (buf[s] == 0x20)  # no white space but one leading space
        raw = buf.tobytes()
        s, e = s.tolist(), e.tolist()
        plain, rest = np.flatnonzero(lone), np.flatnonzero(~lone)
        flat, count = [], []
        if len(plain):  # one call for all, with line ends in between
            got = np.frombuffer(self.enc.encode_to_numpy(b"\n".join([raw[s[i]: e[i]] for i in plain.tolist()]).decode()), np.uint32)
            sep = got == self.line
            at = np.flatnonzero(sep)
            count.append(np.diff(np.concatenate(([-1], at, [len(got)]))) - 1)
            flat.append(got[~sep])
        for i in rest.tolist():
            flat.append(np.array(self.enc.encode_ordinary(raw[s[i]: e[i]].decode()), np.uint32))
            count.append(np.array([len(flat[-1])], np.int64))
        n = np.concatenate(count).astype(np.int64)
        order, entry = np.concatenate([plain, rest]), len(self.count) + np.arange(len(new))
        begin, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        begin[order], count[order] = len(self.flat) + np.cumsum(n) - n, n
        self.first, self.count = np.append(self.first, begin), np.append(self.count, count)
        self.flat = np.concatenate([self.flat, *flat])
        if known:
            self._put(new, entry)
        return entry

    def _grow(self) -> None:
        """Keep the table at most four fifths full (only a text with very many chunks needs it)."""
        if 5 * len(self.count) > 4 * len(self.table):
            h, e = self.table[self.table != 0], self.entry[self.table != 0]
            self.table, self.entry = np.zeros(2 * len(self.table), np.uint64), np.zeros(2 * len(self.table), np.int32)
            self._put(h, e)

    def encode(self, buf: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and their bounds."""
        starts = chunk_starts(buf, ends)
        text_from = np.concatenate(([0], ends[:-1] + 1))
        stops = np.append(starts[1:], len(buf))
        last = np.searchsorted(starts, ends, side="left") - 1  # last chunk of each text, cut at the text's end
        empty = ends == text_from
        stops[last[~empty]] = ends[~empty]
        # a start at each text's end stands for the end token
        h = T.span_hash(buf, starts, np.maximum(stops, starts)) | np.uint64(1 << 63)
        closing = np.searchsorted(starts, ends)
        real = np.ones(len(starts), bool)
        real[closing] = False
        h, rs, re_ = h[real], starts[real], stops[real]
        if len(self.count) > CACHE_CHUNKS:
            self.reset()
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            uniq, at = np.unique(h[new], return_index=True)
            for i in range(0, len(uniq), CACHE_CHUNKS):  # a huge text may hold more than the cache
                self._learn(uniq[i: i + CACHE_CHUNKS], buf, rs[new[at[i: i + CACHE_CHUNKS]]], re_[new[at[i: i + CACHE_CHUNKS]]])
                self._grow()
            entry[new] = self._find(h[new])
        twin = np.flatnonzero(~self._same(entry, buf, rs, re_))
        if len(twin):  # another text with the hash of a known one
            entry[twin] = self._learn(h[twin], buf, rs[twin], re_[twin], known=False)
        n = np.ones(len(starts), np.int64)
        src = np.zeros(len(starts), np.int64)
        n[real], src[real] = self.count[entry], self.first[entry]
        total = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(src - total[:-1], n) + np.arange(total[-1])
        take[total[closing]] = 0
        out = self.flat[take] if len(self.flat) else np.zeros(total[-1], np.uint32)
        out[total[closing]] = end_id
        return out, np.concatenate(([0], total[closing + 1]))


def chunk_starts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens surely begin: text starts and ends, a space between two characters that
    are no white space, both sides of such a line end, and ASCII punctuation after a letter
    (ASCII or Latin-1) or digit.  Next to bytes that may belong to other white space nothing
    else is cut."""
    n = len(buf)
    odd = buf <= 0x20  # white space or control
    lead = (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))  # of a multi-byte white space
    before = np.ones(n, bool)  # the byte before ends a character that may be white space
    before[1:] = odd[:-1]
    before[2:] |= lead[:-2] & (buf[1:-1] >= 0x80)
    before[3:] |= lead[:-3] & (buf[1:-2] >= 0x80) & (buf[2:-1] >= 0x80)
    after = np.ones(n, bool)
    after[:-1] = odd[1:] | lead[1:]
    alone = ~before & ~after
    cut = alone & ((buf == 0x20) | (buf == 0x0A))
    cut[1:] |= alone[:-1] & (buf[:-1] == 0x0A)
    cut[1:] |= ALNUM[buf[:-1]] & PUNCT[buf[1:]]
    cut[2:] |= (buf[:-2] == 0xC3) & (buf[1:-1] != 0x97) & (buf[1:-1] != 0xB7) & PUNCT[buf[2:]]
    cut[0] = True
    cut[ends] = True
    cut[ends[:-1] + 1] = True
    return np.flatnonzero(cut)


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of that file, with its cache."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]
