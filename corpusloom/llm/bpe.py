"""Byte-pair encoding as a left-to-right transducer with bounded lookahead.

The encoder never looks for the best merge of a whole piece. It keeps, for each prefix of the bytes
read so far, the last token of that prefix's encoding; the rest of the encoding follows from where
that token starts. A new prefix's last token is the one token ending there that may follow the last
token of what is before it. Two tokens may stand side by side if no merge across their border comes
due before the merges that build them (:meth:`MergeTable.adjacent`).

A token is emitted once it lies on the encodings of all prefixes that a later token can start from.
How many bytes after a token can still change it follows from the merges alone: a merge to its right
adds the bytes of its partner, and what may follow the merged token. The most of any token is the
``lookahead``, so the window stays small however long the input is.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import regex

#: Fixed value: the published split pattern of the byte-level tokenizers.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces and token pairs that one Python worker remembers; beyond that the memory is emptied.
REMEMBERED = 1_000_000
#: Characters of a text whose pieces are listed at once; those of longer ones come one by one.
LISTED = 65_536


def byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable ones stand for themselves, the others for 256 onwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """The vocabulary and ordered merges of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_characters()
        raw = {text: bytes(of[c] for c in text) for text in model["vocab"] if all(c in of for c in text)}
        ids = {raw[text]: i for text, i in model["vocab"].items() if text in raw}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._after: dict[int, dict[int, int]] = {}  # left token -> right token -> order of their merge
        built: dict[int, tuple[int, int, int]] = {}
        for order, (left, right) in enumerate(merges):
            a, b, whole = raw[left], raw[right], raw[left] + raw[right]
            self._after.setdefault(ids[a], {})[ids[b]] = order
            built.setdefault(ids[whole], (order, ids[a], ids[b]))
        self.id = {piece: i for piece, i in ids.items() if len(piece) == 1 or i in built}
        self.bytes = {i: piece for piece, i in ids.items()}
        self._built = built
        self.longest = max(map(len, self.id))
        #: Of every token, how many bytes after it merges can reach; merges that use a token come after the one that builds it.
        self.reach = dict.fromkeys(self.bytes, 0)
        for left, right in reversed(merges):
            a, b = ids[raw[left]], ids[raw[right]]
            further = self.reach[ids[raw[left] + raw[right]]]
            self.reach[a] = max(self.reach[a], len(raw[right]) + further)
            self.reach[b] = max(self.reach[b], further)
        self.lookahead = max(self.reach.values(), default=0)
        #: Of every token and every beginning of one: the token's id, or -1.
        self.beginnings = {piece[:k]: -1 for piece in self.id for k in range(1, len(piece))} | self.id
        self.prefixes = {piece[:k] for piece in self.id for k in range(1, len(piece))}
        self._edge: tuple[dict, dict] = ({}, {})
        self.adjacent_pairs: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of ``token`` at its right (side 1) or left (side 0) border, each with the order of the merge that uses it up."""
        known = self._edge[side].get(token)
        if known is None:
            known, used = [(token, float("inf"))], token
            while used in self._built:
                order, left, right = self._built[used]
                used = right if side else left
                known.append((used, order))
            self._edge[side][token] = known
        return known

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to just these two."""
        key = left << 24 | right
        known = self.adjacent_pairs.get(key)
        if known is None:
            known = True
            fronts = self._spine(right, 0)
            for a, a_until in self._spine(left, 1):
                after = self._after.get(a)
                if after:
                    for b, b_until in fronts:
                        # of equal merges the left one comes first
                        if b in after and after[b] < a_until and after[b] <= b_until:
                            known = False
                            break
                    if not known:
                        break
            if len(self.adjacent_pairs) >= REMEMBERED:
                self.adjacent_pairs.clear()
            self.adjacent_pairs[key] = known
        return known


class Transducer:
    """Encodes the bytes of one piece; ``window`` is the most bytes it has held."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.window = 0

    def encode(self, piece: bytes) -> list[int]:
        m = self.merges
        out: list[int] = []
        base, before, size = 0, -1, 5 * max(1, m.lookahead)  # all before ``base`` is emitted; the last token there
        while base < len(piece):
            end = min(len(piece), base + size)
            # of prefixes whose last token may begin at any byte of the window, that token and its start are known
            known = end - base if end == len(piece) else end - base - m.longest
            if known > 0:
                last, start = self._prefixes(piece, base, end, known, before)
                cut = known if end == len(piece) else self._stable(piece, base, known, start)
                if cut:
                    self.window = max(self.window, end - base)
                    out += self._path(last, start, cut)
                    before, base, size = out[-1], base + cut, 5 * max(1, m.lookahead)
                    continue
            size *= 2
        return out

    def _prefixes(self, piece: bytes, base: int, end: int, known: int, before: int) -> tuple[list[int], list[int]]:
        """The last token of each prefix of the window and where it starts; -1 for those that no path from ``base`` ends."""
        beginnings, adjacent, seen, n = self.merges.beginnings.get, self.merges.adjacent, self.merges.adjacent_pairs.get, end - base
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        start[0] = 0
        for at in range(known):
            if start[at] < 0:
                continue
            left, head = (last[at] if at else before), base + at
            for to in range(at + 1, n + 1):
                token = beginnings(piece[head : base + to])
                if token is None:
                    break
                # the longest token that may end here is the one; it was met first
                if token >= 0 and start[to] < 0:
                    fits = left < 0 or seen(left << 24 | token)
                    if fits or (fits is None and adjacent(left, token)):
                        last[to], start[to] = token, at
        return last, start

    @staticmethod
    def _path(last: list[int], start: list[int], end: int) -> list[int]:
        tokens = []
        while end > 0:
            tokens.append(last[end])
            end = start[end]
        return tokens[::-1]

    def _stable(self, piece: bytes, base: int, n: int, start: list[int]) -> int:
        """The last border shared by all encodings from which a later token may go on."""
        shared, end = None, base + n
        for at in range(n, max(-1, n - self.merges.longest), -1):
            if start[at] < 0 or (at < n and piece[base + at : end] not in self.merges.prefixes):
                continue
            borders, k = set(), at
            while k > 0:
                borders.add(k)
                k = start[k]
            shared = borders if shared is None else shared & borders
        return max(shared or {0})


class Encoder:
    """Texts to token ids, without special tokens. Empty and null texts give an empty list."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.merges = MergeTable(path)
        self._transducer = Transducer(self.merges)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(SPLIT_PATTERN)

    def into(self, out: array, text: str | None) -> None:
        """Append the ids of ``text`` to ``out``."""
        if not text:
            return
        known, extend = self._pieces, out.extend
        # a long text's pieces are not listed at once
        pieces = self._split.findall(text) if len(text) <= LISTED else (m[0] for m in self._split.finditer(text))
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self._transducer.encode(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.into(out, text)
        return out.tolist()


class Decoder:
    """Token ids to text, one id at a time: a state machine over the bytes of UTF-8 holds back an unfinished character."""

    def __init__(self, merges: MergeTable):
        self._bytes = merges.bytes
        self._held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if back < need else 0
            if lead < 0x80:
                return 0
        return 0

    def push(self, token: int) -> str:
        data = self._held + self._bytes[token]
        cut = len(data) - self._unfinished(data)
        self._held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self._held = self._held.decode("utf-8", "replace"), b""
        return rest


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker, kept between tasks."""
    return Encoder(path)


def decode(merges: MergeTable, ids) -> str:
    machine = Decoder(merges)
    return "".join([machine.push(i) for i in ids]) + machine.finish()
