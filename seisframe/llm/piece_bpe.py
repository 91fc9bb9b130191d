"""SentencePiece-compatible byte-pair encoding and decoding by vectorised merge rounds.

A block of texts becomes flat numpy arrays: one symbol per character, grouped
into segments across which no piece of the vocabulary reaches. In each round
every segment finds its best pair, all its leftmost non-overlapping
occurrences merge at once, and the arrays are compacted, until no segment has
a pair. A very long segment goes through the rounds for low ranks first and is
split for them where no piece of such a rank, made of whole symbols, reaches
across. Where merging one occurrence could make a pair that goes before the
next occurrence (``Codec.risky``), that segment merges one occurrence a round, so the
result is always that of the sequential algorithm.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import common, vocabulary
from .vocabulary import SPACE

#: Words kept encoded between blocks, and the length from which a segment is split for the ranks merged so far.
CACHE_WORDS, LONG_SEGMENT = 300_000, 4096
#: A long segment is merged up to these ranks in turn.
LIMITS = [int(64 * 2 ** (k / 2)) for k in range(18)] + [1 << 62]
#: Characters encoded together.
BLOCK = 2_000_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CODES = 0x110000


def gather(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the rows ``which`` of a ragged array, and their lengths."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[which] - (ends - lengths), lengths)
    return flat, lengths


class HashIndex:
    """Positions of int64 keys by open addressing; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.values[slot] < 0
            self.values[slot[free]] = todo[free]  # of several that meet in a slot the last one gets it
            won = self.values[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot = (slot if len(slot) == len(open_) else slot[open_]) + 1 & (len(self.keys) - 1)
            own = keys[open_]
            found = self.keys[slot]
            same = found == own
            out[open_[same]] = self.values[slot[same]]
            more = ~same & (found != -1)
            open_, slot = open_[more], slot[more]
        return out


class Codec:
    """Encoder and decoder for one byte-pair model file."""

    def __init__(self, file: str):
        model = vocabulary.piece_model(file)
        if model.model_type != 2 or model.charsmap or model.remove_extra_whitespaces:
            raise ValueError("only byte-pair models without text normalisation are supported")
        self.model, self.size = model, len(model.pieces)
        self.chars = np.array([len(p.text) for p in model.pieces])
        merged = self.merged = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (vocabulary.NORMAL, vocabulary.USER_DEFINED)}
        score = np.array([p.score for p in model.pieces])
        #: rank[i]: lower merges first; equal for equal scores
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        ties = np.bincount(self.rank[list(merged.values())], minlength=self.size + 1)
        self.symbol = np.arange(self.size, self.size + _CODES, dtype=np.int64)  # a character without a piece keeps its code
        for text, i in merged.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        pairs, bigrams = {}, set()
        for text, i in merged.items():
            bigrams.update(zip(text, text[1:]))
            for k in range(1, len(text)):
                left, right = self._part(merged, text[:k]), self._part(merged, text[k:])
                if left is not None and right is not None:
                    follow = merged.get(text + text[:k])
                    pairs[left, right] = (i, bool(ties[self.rank[i]] > 1 or follow is not None and self.rank[follow] <= self.rank[i]))
        base = self.size + _CODES
        keys = np.array([a * base + b for a, b in pairs], dtype=np.int64)
        self.pair_index, self.base = HashIndex(keys), base
        self.pair_ids = np.array([i for i, _ in pairs.values()], dtype=np.int64)
        self.risky = np.array([r for _, r in pairs.values()], dtype=bool)
        self.pairs = {k: v[0] for k, v in pairs.items()}
        self.bigrams = HashIndex(np.array([ord(a) * _CODES + ord(b) for a, b in bigrams], dtype=np.int64))
        self.byte_ids = np.zeros(256, dtype=np.int64)
        raw = []
        for i, p in enumerate(model.pieces):
            if p.kind == vocabulary.BYTE:
                self.byte_ids[int(p.text[3:5], 16)] = i
                raw.append(bytes([int(p.text[3:5], 16)]))
            elif p.kind == vocabulary.CONTROL:
                raw.append(b"")
            elif p.kind == vocabulary.UNKNOWN:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(p.text.replace(SPACE, " ").encode())
        self.raw = raw
        self.raw_offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        digits = [f"{i},".encode() for i in range(self.size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        self.digit_bytes = np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.space_id = int(self.symbol[ord(SPACE)])
        self.leading = np.array([p.kind == vocabulary.NORMAL and p.text.startswith(SPACE) for p in model.pieces])
        self._forget()

    def _part(self, merged: dict, text: str) -> int | None:
        return merged.get(text, int(self.symbol[ord(text)]) if len(text) == 1 else None)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store = np.empty(0, dtype=np.int32)
        self.store_offsets = np.zeros(1, dtype=np.int64)

    @lru_cache(maxsize=4096)
    def _spaces(self, n: int) -> tuple[int, ...]:
        """Ids of a run of n space marks that nothing else joins."""
        if n > 64:  # such runs start like a run shorter by one period
            return self._period[0] * ((n - 32) // self._period[1]) + self._spaces(32 + (n - 32) % self._period[1])
        return tuple(self.sequential([self.space_id] * n))

    @property
    def _period(self) -> tuple[tuple[int, ...], int]:
        whole = self.sequential([self.space_id] * 128)
        first = whole[0]
        return (first,), len(self.model.pieces[first].text)

    def sequential(self, symbols: list[int]) -> list[int]:
        """Best pair first, leftmost among equals, one merge at a time, with a heap."""
        ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids) and (m := self.pairs.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    @cached_property
    def _lattice(self):
        """All pieces by their text, and their ranks (a last one for no piece)."""
        from .language_id import Lattice

        own = Lattice(sorted(self.merged))
        return own, np.array([*(self.rank[self.merged[t]] for t in own.pieces), 1 << 62])

    def _long(self, codes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Merge rounds over one very long segment.

        Up to a limit of rank, parts of the segment do not affect each other
        if no piece below the limit that begins and ends where symbols do
        reaches from one into the other; so all parts have their rounds at once.
        """
        lattice, ranks = self._lattice
        found = [ranks[e[0]] for e in lattice.edges(codes[None].astype(np.uint32))]
        n = len(codes)
        for limit in LIMITS:
            starts = np.concatenate([[0], np.cumsum(np.where(symbols < self.size, self.chars[np.minimum(symbols, self.size - 1)], 1))])
            whole = np.zeros(n + 1, dtype=bool)
            whole[starts] = True
            change = np.zeros(n + 2, dtype=np.int32)  # of the number of pieces that reach across a place
            for size, rank in enumerate(found[1:], 2):
                at = (rank < limit) & whole[: n - size + 1] & whole[size:]
                change[1 : n - size + 2] += at
                change[size : n + 1] -= at
            crossed = np.cumsum(change)[starts[1:-1]] > 0
            symbols, _ = self._merge(symbols, np.concatenate([[0], np.cumsum(~crossed)]), limit)
        return symbols

    def _merge(self, symbols: np.ndarray, segment: np.ndarray, limit: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds, of ranks below the limit, over flat symbols grouped by (non-decreasing) segment; returns what is left, in order."""
        done_s, done_g = [], []
        while len(symbols) > 1:
            keys = symbols[:-1] * self.base + symbols[1:]
            at = self.pair_index.find(keys)
            places = np.flatnonzero((at >= 0) & (segment[:-1] == segment[1:]))
            places = places[self.rank[self.pair_ids[at[places]]] < limit]
            if not len(places):
                break
            pair = at[places]
            rank, own = self.rank[self.pair_ids[pair]], segment[places]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(own)]]))
            best = np.minimum.reduceat(rank, starts)
            chosen = np.flatnonzero(rank == np.repeat(best, counts))
            places, pair, own = places[chosen], pair[chosen], own[chosen]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            linked = np.concatenate([[False], places[1:] == places[:-1] + 1])  # overlaps the place before
            head = np.maximum.accumulate(np.where(~linked, np.arange(len(places)), 0))
            keep = ((np.arange(len(places)) - head) % 2 == 0) & (first | ~self.risky[pair])
            risky_first = np.repeat(self.risky[pair[first]], np.diff(np.concatenate([np.flatnonzero(first), [len(own)]])))
            keep &= first | ~risky_first
            places, pair = places[keep], pair[keep]
            symbols = symbols.copy()
            symbols[places] = self.pair_ids[pair]
            left = np.ones(len(symbols), dtype=bool)
            left[places + 1] = False
            symbols, segment = symbols[left], segment[left]
            # segments without a pair are set aside when they are half of all
            busy = np.unique(own)
            if len(busy) * 2 < (len(np.unique(segment)) if len(symbols) < 1 << 16 else segment[-1] + 1):
                idle = ~np.isin(segment, busy)
                done_s.append(symbols[idle])
                done_g.append(segment[idle])
                symbols, segment = symbols[~idle], segment[~idle]
        done_s.append(symbols)
        done_g.append(segment)
        symbols, segment = np.concatenate(done_s), np.concatenate(done_g)
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct words, each of space marks and then other characters."""
        runs = [len(w) - len(w.lstrip(SPACE)) for w in words]
        cores = [w[max(r - 1, 0) :] if len(w) > r else "" for w, r in zip(words, runs, strict=True)]
        codes = np.frombuffer("".join(cores).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(c) for c in cores])
        symbols = self.symbol[codes]
        if len(codes):
            crossing = codes[:-1] * _CODES + codes[1:]
            cut = (self.bigrams.find(crossing) < 0) | (word[1:] != word[:-1])
            segment = np.concatenate([[0], np.cumsum(cut)])
            owner = word[np.concatenate([[True], cut])]  # of each segment
            sizes = np.bincount(segment)
            long = np.flatnonzero(sizes > LONG_SEGMENT)
            if len(long):
                first = np.concatenate([[0], np.cumsum(sizes)])
                parts, last = [], 0
                for g in long.tolist():
                    a, b = int(first[g]), int(first[g + 1])
                    own = self._long(codes[a:b], symbols[a:b])
                    parts += [(symbols[last:a], segment[last:a]), (own, np.full(len(own), g))]
                    last = b
                parts.append((symbols[last:], segment[last:]))
                symbols, segment = (np.concatenate(x) for x in zip(*parts))
            symbols, segment = self._merge(symbols, segment)
            word = owner[segment]
        symbols, word = self._fall_back(symbols, word)
        long = [k for k, r in enumerate(runs) if r > 1 or not cores[k]]
        if long:  # runs of space marks: the last one may have joined what follows
            bounds = np.searchsorted(word, np.arange(len(words) + 1))
            parts, last = [], 0
            counts = np.diff(bounds)
            for k in long:
                own = symbols[bounds[k] : bounds[k + 1]]
                parts.append(symbols[last : bounds[k]])
                apart = not len(own) or own[0] == self.space_id
                spaces = self._spaces(runs[k] - (not apart))
                rest = own[1:] if len(own) and apart else own
                parts += [np.array(spaces, dtype=np.int64), rest]
                counts[k] = len(spaces) + len(rest)
                last = bounds[k + 1]
            parts.append(symbols[last:])
            symbols, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        else:
            offsets = np.searchsorted(word, np.arange(len(words) + 1))
        return symbols, offsets

    def _fall_back(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, word
        if not self.model.byte_fallback:
            symbols = symbols.copy()
            symbols[odd] = self.model.unk_id
            return symbols, word
        code = symbols[odd] - self.size
        length = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        counts = np.ones(len(symbols), dtype=np.int64)
        counts[odd] = length
        out = np.repeat(symbols, counts)
        starts = (np.cumsum(counts) - counts)[odd]
        raw = np.frombuffer("".join(map(chr, code)).encode(), dtype=np.uint8)
        out[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(len(raw))] = self.byte_ids[raw]
        return out, np.repeat(word, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offset of each text."""
        words: list[str] = []
        counts = []
        for text in texts:
            own = _WORD.findall((SPACE if self.model.add_dummy_prefix else "") + text.replace(" ", SPACE)) if text else []
            counts.append(len(own))
            words += own
        if not words:
            return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        distinct = dict.fromkeys(words)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            ids, offsets = self._encode_words(new)
            start = len(self.store_offsets) - 1
            self.store_offsets = np.concatenate([self.store_offsets, offsets[1:] + len(self.store)])
            self.store = np.concatenate([self.store, ids.astype(np.int32)])
            self.known.update(zip(new, range(start, start + len(new))))
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        flat, lengths = gather(self.store_offsets, rows)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.store[flat].astype(np.int64), total[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence of ids."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0].decode()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each sequence."""
        out = []
        for k in range(len(offsets) - 1):
            own = np.asarray(ids[offsets[k] : offsets[k + 1]], dtype=np.int64)
            if not len(own):
                out.append(b"")
                continue
            parts = []
            for i in range(0, len(own), 1 << 20):
                parts.append(self.raw_bytes[gather(self.raw_offsets, own[i : i + (1 << 20)])[0]].tobytes())
            data = b"".join(parts)
            kinds = next((int(i) for i in own if self.raw[i]), None)  # the first that isn't a control piece
            if kinds is not None and self.leading[kinds] and (self.model.add_dummy_prefix or self.model.remove_extra_whitespaces):
                data = data[1:]
            try:
                data.decode()
            except UnicodeDecodeError:
                data = self._repaired(own)
            out.append(data)
        return out

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Each byte of an invalid sequence of byte pieces becomes U+FFFD."""
        out, run, began = [], b"", False

        def flush() -> None:
            nonlocal run
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode().encode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    run = run[1:]

        for i in ids:
            if self.model.pieces[i].kind == vocabulary.BYTE:
                run += self.raw[i]
                continue
            flush()
            piece = self.raw[i]
            if piece and not began and not out and self.leading[i]:
                piece = piece[1:]
            began = began or bool(self.raw[i])
            out.append(piece)
        flush()
        return b"".join(out)

    def joined(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        parts = [self.digit_bytes[gather(self.digit_offsets, ids[i : i + (1 << 20)])[0]].tobytes() for i in range(0, len(ids), 1 << 20)]
        return b"".join(parts)[:-1]


@lru_cache(maxsize=2)
def codec(file: str) -> Codec:
    return Codec(file)


def encode_column(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; null and empty texts have no ids."""

    def run(ids: list, texts: list[str]) -> dict:
        flat, offsets = codec(file).encode(texts)
        return {"doc_id": ids, "ids": [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]}

    return common.map_blocks(docs, run, "doc_id long, ids array<int>", id_col, text_col, BLOCK)


def digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, and the digests of nothing. Rows with
    a null or repeated id are encoded like others. Other columns are not read.
    """

    def run(ids: list, texts: list[str]) -> dict:
        own = codec(file)
        flat, offsets = own.encode(texts)
        decoded = own.decode_all(flat, offsets)
        return {
            "doc_id": ids,
            "n_tokens": np.diff(offsets),
            "ids_sha256": [hashlib.sha256(own.joined(flat[a:b])).hexdigest() for a, b in zip(offsets, offsets[1:])],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
        }

    return common.map_blocks(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, BLOCK)
