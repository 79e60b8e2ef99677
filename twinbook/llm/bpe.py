"""Byte-pair encoding as a streaming transducer, and its inverse.

Texts are read in pieces (the vocabulary's own splitting pattern) and each piece becomes tokens by the merge list. Every
piece is read byte by byte, and the tokens of those of ordinary length are remembered: the merged form of every prefix is
the merged form of a shorter prefix and one token (the only one that merges with neither its predecessor nor across it),
so that a table of last tokens over the ``lookahead`` latest positions is all the state there is; tokens that all of these
positions have in common can no longer change and are emitted. ``lookahead`` is the longest token: no token that begins
now ends further on, so every continuation passes through one of the positions kept.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import regex

#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Encoder over a rank file (base64 token and rank a line); special tokens are not known to it."""

    def __init__(self, path: str, long_piece: int = 256, remembered: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        self.long_piece, self.remembered = long_piece, remembered
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a short run of bytes: the pair of lowest rank is joined, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _pair(self, left: int, right: int) -> bool:
        """Whether two tokens in a row stay as they are."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.remembered:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece given byte by byte, each emitted once no continuation can change it."""
        width = self.lookahead
        window = bytearray()
        # chain[i]: the tokens not yet emitted of the prefix that ends at window position i, as (last token, its start).
        last: list[tuple[int, int] | None] = [None]
        for byte in data:
            window.append(byte)
            n = len(window)
            found = None
            for start in range(max(0, n - width), n):
                token = self.ranks.get(bytes(window[start:n]))
                if token is None or (start and last[start] is None):
                    continue
                if start == 0 or self._pair(last[start][0], token):
                    found = (token, start)
                    break
            last.append(found)
            if n >= 4 * width:
                yield from self._settle(window, last)
        yield from self._chain(last, len(window))

    @staticmethod
    def _chain(last: list, end: int) -> list[int]:
        tokens = []
        while end:
            token, end = last[end]
            tokens.append(token)
        return tokens[::-1]

    def _settle(self, window: bytearray, last: list) -> list[int]:
        """Emits and forgets what the latest ``lookahead`` positions have in common, but for its last token, which is kept as context."""
        paths = []
        for end in range(len(window) - self.lookahead + 1, len(window) + 1):
            if last[end] is not None:
                stops, at = [end], end
                while at:
                    at = last[at][1]
                    stops.append(at)
                paths.append(stops[::-1])
        shared = 0
        while all(len(p) > shared + 1 for p in paths) and len({p[shared + 1] for p in paths}) == 1:
            shared += 1
        if shared < 2:
            return []
        cut = paths[0][shared - 1]
        emitted = self._chain(last, cut)
        keep = last[cut:]
        del window[:cut]
        last[:] = [None] + [None if x is None or x[1] < cut else (x[0], x[1] - cut) for x in keep[1:]]
        return emitted

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none. Strings of special tokens are ordinary text."""
        out: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "replace")
                if len(data) > self.long_piece:  # too long to be remembered
                    out.extend(self.stream(data))
                    continue
                if len(known) >= self.remembered:
                    known.clear()
                ids = known[piece] = tuple(self.stream(data))
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, each part as soon as its bytes are whole characters; broken bytes give U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.tokens[int(i)]):
                yield part
        if part := machine.decode(b"", True):
            yield part
