"""Variable-width LZW as images use it, lossless and lossy.

A stream is first a list of codes; NumPy packs the bits in one go.  Lossless
matches walk one flat dictionary keyed by (code, symbol), and the width of a
code follows from its place since the last clear.  The lossy search needs the
children of a node, so its dictionary is a trie.  Parallelism is by frame, in
`chromaflow.operators.gif`.
"""

from __future__ import annotations

import numpy as np

MAX_CODES, MAX_WIDTH = 4096, 12
# Fixed point of the mean match length, its decay, and the limits below which a full dictionary is dropped.
SCALE, DECAY, SHORT, PER_PIXEL = 19, 4, 36, (1 << 19) // 3000
#: Dictionary nodes a lossy search may visit for one match.
VISITS = 4096


class Codes:
    """The code stream with the state both ways of encoding share."""

    def __init__(self, min_bits: int):
        self.min_bits, self.clear = min_bits, 1 << min_bits
        self.values: list[int] = []
        self.widths: list[int] = []
        self.width = min_bits + 1
        self.put(self.clear)
        self.reset()

    def put(self, code: int) -> None:
        self.values.append(code)
        self.widths.append(self.width)

    def reset(self) -> None:
        self.width = self.min_bits + 1
        self.next = self.clear + 2
        self.mean = 1 << SCALE
        self.children: dict[int, dict[int, int]] = {}

    def matched(self, code: int, length: int, symbol: int, left: int) -> None:
        """Emits a match that `symbol` follows, with `left` symbols still to come."""
        self.put(code)
        target = (length << SCALE) + (1 << (DECAY - 1))
        self.mean += -((self.mean - target) >> DECAY) if target < self.mean else (target - self.mean) >> DECAY
        if self.next < MAX_CODES:
            own = self.children.setdefault(code, {})
            if symbol in own:  # a search that ran out of visits stopped short of it
                return
            own[symbol] = self.next
            if self.next == 1 << self.width:
                self.width += 1
            self.next += 1
        elif self.mean < (SHORT << SCALE) // self.min_bits or self.mean < left * PER_PIXEL:
            self.put(self.clear)
            self.reset()

    def finish(self, code: int | None) -> bytes:
        """The last match and the end code.  A reader adds an entry on reading the last
        match, so its width may have grown."""
        if code is not None:
            self.put(code)
            if self.next == 1 << self.width and self.width < MAX_WIDTH:
                self.width += 1
        self.put(self.clear + 1)
        return pack(np.array(self.values, dtype=np.uint16), np.array(self.widths, dtype=np.uint8))


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most MAX_WIDTH bits, one after the other from the lowest bit."""
    bits = np.unpackbits(values.astype("<u2")[:, None].view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def place_widths(values: np.ndarray, min_bits: int) -> np.ndarray:
    """Widths of a lossless stream: the k-th code after a clear (which takes the width of
    its own place) is read when the newest entry is clear + 1 + k, or the last one."""
    clear = 1 << min_bits
    cleared = np.flatnonzero(values == clear)
    since = np.arange(len(values)) - np.repeat(cleared + 1, np.diff(np.append(cleared, len(values))))
    # a clear itself belongs to the codes before it; the first has the least width
    since[cleared] = np.diff(cleared, prepend=-1) - 1
    newest = np.minimum(clear + 1 + since, MAX_CODES - 1)
    return np.searchsorted(1 << np.arange(MAX_WIDTH), newest, side="right").astype(np.uint8)


def encode(data: bytes, min_bits: int) -> bytes:
    """Greedy longest matches."""
    clear = 1 << min_bits
    codes = [clear]
    if data:
        put, short, left = codes.append, (SHORT << SCALE) // min_bits, len(data)
        half = 1 << (DECAY - 1)
        symbols = iter(data)
        node = next(symbols)
        table: dict[int, int] = {}
        find = table.get
        lengths = [1] * MAX_CODES
        entry, mean = clear + 2, 1 << SCALE
        for symbol in symbols:
            key = node << 8 | symbol
            found = find(key)
            if found is not None:
                node = found
                continue
            put(node)
            length = lengths[node]
            left -= length
            gap = (length << SCALE) + half - mean
            mean += gap >> DECAY if gap >= 0 else -(-gap >> DECAY)
            if entry < MAX_CODES:
                table[key] = entry
                lengths[entry] = length + 1
                entry += 1
            elif mean < short or mean < left * PER_PIXEL:
                put(clear)
                table.clear()
                entry, mean = clear + 2, 1 << SCALE
            node = symbol
        put(node)
    codes.append(clear + 1)
    values = np.array(codes, dtype=np.uint16)
    return pack(values, place_widths(values, min_bits))


class Lossy:
    """Matches that may write a near colour for the one wanted.

    level: squared error a pixel may have, in tens; near[i]: colours that may
    stand for i, nearest first; the transparent index stands for itself only."""

    def __init__(self, palette: np.ndarray, trans: int, level: int, near: list[list[int]]):
        self.colors = [tuple(int(v) for v in c) for c in palette]
        self.trans, self.cap, self.near = trans, level * 10, near

    def cost(self, want: int, got: int, carry: tuple[int, int, int]) -> int:
        """Squared error with all or half of the carried error, whichever is less."""
        whole = half = 0
        for a, b, c in zip(self.colors[want], self.colors[got], carry, strict=True):
            whole += (a - b + c) ** 2
            half += (a - b + int(c / 2)) ** 2
        return min(whole, half)

    def carried(self, want: int, got: int, carry: tuple[int, int, int]) -> tuple[int, int, int]:
        if self.trans in (want, got):
            return 0, 0, 0
        return tuple(a - b + int(c * 3 / 4) for a, b, c in zip(self.colors[want], self.colors[got], carry, strict=True))

    def match(self, data: bytes, scale: bytes | None, start: int, children: dict[int, dict[int, int]]) -> tuple[int, int]:
        """(code, end) of the longest match from `start`, then of the least error, then the first found.
        Depth first: the exact symbol, then its stand-ins from the nearest on."""
        size, best = len(data), (data[start], start + 1, 0)
        stack = [(data[start], start + 1, 0, (0, 0, 0))]
        visits = VISITS
        while stack and visits:
            node, at, error, carry = stack.pop()
            visits -= 1
            if at > best[1] or (at == best[1] and error < best[2]):
                best = node, at, error
                if at == size and error == 0:
                    break
            own = children.get(node)
            if at == size or not own:
                continue
            want, follow = data[at], []
            if want in own:
                follow.append((own[want], at + 1, error, self.carried(want, want, carry)))
            if want != self.trans:
                cap = self.cap if scale is None else self.cap * scale[at] >> 8
                for got in self.near[want]:
                    if got in own and (cost := self.cost(want, got, carry)) <= cap:
                        follow.append((own[got], at + 1, error + cost, self.carried(want, got, carry)))
            stack.extend(reversed(follow))
        return best[0], best[1]


def encode_lossy(data: bytes, min_bits: int, lossy: Lossy, scale: bytes | None = None) -> bytes:
    out = Codes(min_bits)
    if not data:
        return out.finish(None)
    start, size = 0, len(data)
    while True:
        node, at = lossy.match(data, scale, start, out.children)
        if at == size:
            return out.finish(node)
        out.matched(node, at - start, data[at], size - at)
        start = at


def decode(data: bytes, min_bits: int) -> bytes:
    """The symbols of a stream, read on its own terms (for tests and readers)."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, at, width, out = 1 << min_bits, 0, min_bits + 1, bytearray()
    words: list[bytes] = []
    last = None
    while True:
        chunk = bits[at : at + width]
        if len(chunk) < width:
            raise ValueError("the stream ends before its end code")
        code, at = int(chunk @ (1 << np.arange(width))), at + width
        if code == clear:
            words, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], min_bits + 1, None
            continue
        if code == clear + 1:
            return bytes(out)
        if last is not None and len(words) < MAX_CODES:
            words.append(last + (words[code] if code < len(words) else last)[:1])
        last = words[code]
        out += last
        if len(words) == 1 << width and width < MAX_WIDTH:
            width += 1
