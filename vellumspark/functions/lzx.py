"""LZX decompression, from the format's public description: a 2 to the 15 to 2 to the 21 byte window, canonical Huffman codes whose
lengths are sent as differences, three repeated offsets, and calls (E8) with absolute targets turned back.

Experimental: no real files were at hand; streams are tested against hand-made ones.
"""

from __future__ import annotations

FRAME = 1 << 15
VERBATIM, ALIGNED, STORED = 1, 2, 3
#: Symbols of the code of lengths, of the main code before matches, of the code of longer lengths.
PRE, LITERALS, LENGTHS = 20, 256, 249


class LzxError(ValueError):
    pass


def slots(bits: int) -> int:
    """Position slots of a window of so many bits."""
    return {20: 42, 21: 50}.get(bits, 2 * bits)


def _positions() -> list[tuple[int, int]]:
    """(base, extra bits) of each position slot: two slots for each number of extra bits, which ends at 17."""
    out, base = [], 0
    for slot in range(51):
        extra = 0 if slot < 4 else min((slot - 2) // 2, 17)
        out.append((base, extra))
        base += 1 << extra
    return out


POSITIONS = _positions()


class Bits:
    """Bits of 16-bit little-endian words, the highest first; nought beyond the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 16 | int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at += 2
            self.n += 16
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def align(self) -> None:
        """To the next word; a whole word is skipped if the place is at its beginning already."""
        if self.n == 0:
            self.at += 2
        self.held = self.n = 0

    def bytes(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        self.at += n
        return part.ljust(n, b"\0")


class Code:
    """A canonical Huffman code from its lengths (0: the symbol isn't used)."""

    def __init__(self, lengths: list[int]):
        self.symbol, code = {}, 0
        for n in range(1, 17):
            for s, length in enumerate(lengths):
                if length == n:
                    self.symbol[n, code] = s
                    code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            found = self.symbol.get((n, code))
            if found is not None:
                return found
        raise LzxError("invalid code")


def _read_lengths(bits: Bits, lengths: list[int], first: int, last: int) -> None:
    pre, at = Code([bits.take(4) for _ in range(PRE)]), first

    def run(n: int, value: int) -> int:
        end = min(at + n, last)
        lengths[at:end] = [value] * (end - at)
        return end

    while at < last:
        symbol = pre.read(bits)
        if symbol == 17:
            at = run(4 + bits.take(4), 0)
        elif symbol == 18:
            at = run(20 + bits.take(5), 0)
        elif symbol == 19:
            n = 4 + bits.take(1)
            at = run(n, (lengths[at] - pre.read(bits)) % 17)
        else:
            at = run(1, (lengths[at] - symbol) % 17)


class Decoder:
    """Frames of one stream, in order; ``reset`` begins anew, as at the marks of a reset table."""

    def __init__(self, window_bits: int):
        if not 15 <= window_bits <= 21:
            raise LzxError(f"invalid window {window_bits}")
        self.n_main = LITERALS + 8 * slots(window_bits)
        self.reset()

    def reset(self) -> None:
        self.out, self.recent = bytearray(), [1, 1, 1]
        self.main, self.long = [0] * self.n_main, [0] * LENGTHS
        self.kind = self.left = self.frames = 0
        self.translated: int | None = None
        self.calls, self.odd = False, False

    def _block(self, bits: Bits) -> None:
        self.kind, self.left = bits.take(3), bits.take(24)
        if self.kind == ALIGNED:
            self.low = Code([bits.take(3) for _ in range(8)])
        if self.kind in (VERBATIM, ALIGNED):
            _read_lengths(bits, self.main, 0, LITERALS)
            _read_lengths(bits, self.main, LITERALS, self.n_main)
            self.calls = self.calls or self.main[0xE8] != 0
            _read_lengths(bits, self.long, 0, LENGTHS)
            self.main_code, self.long_code = Code(self.main), Code(self.long)
        elif self.kind == STORED:
            self.calls = True
            bits.align()
            self.recent = [int.from_bytes(bits.bytes(4), "little") for _ in range(3)]
            self.odd = bool(self.left & 1)
        else:
            raise LzxError(f"invalid block type {self.kind}")

    def _offset(self, bits: Bits, slot: int) -> int:
        if slot < 3:
            offset = self.recent[slot]
            self.recent[slot] = self.recent[0]
        else:
            base, extra = POSITIONS[slot]
            if self.kind == ALIGNED and extra >= 3:
                offset = base - 2 + (bits.take(extra - 3) << 3) + self.low.read(bits)
            else:
                offset = base - 2 + bits.take(extra)
            self.recent[1:] = self.recent[:2]
        self.recent[0] = offset
        return offset

    def frame(self, data: bytes, size: int) -> bytes:
        """The next ``size`` bytes from the data of one frame."""
        bits, begin = Bits(data), len(self.out)
        if self.translated is None:
            self.translated = bits.take(32) if bits.take(1) else 0
        end = begin + size
        while len(self.out) < end:
            if not self.left:
                self._block(bits)
            room = min(self.left, end - len(self.out))
            if self.kind == STORED:
                self.out += bits.bytes(room)
                used = room
                if used == self.left and self.odd:
                    bits.at += 1
            else:
                used = 0
                while used < room:
                    symbol = self.main_code.read(bits)
                    if symbol < LITERALS:
                        self.out.append(symbol)
                        used += 1
                        continue
                    slot, length = divmod(symbol - LITERALS, 8)
                    if length == 7:
                        length += self.long_code.read(bits)
                    offset, length = self._offset(bits, slot), min(length + 2, room - used)
                    if not 0 < offset <= len(self.out):
                        raise LzxError("a match before the start")
                    for _ in range(length):
                        self.out.append(self.out[-offset])
                    used += length
            self.left -= used
        made = bytes(self.out[begin:end])
        self.frames += 1
        return self._calls(made, begin) if self.translated and self.calls and self.frames <= 32768 else made

    def _calls(self, made: bytes, begin: int) -> bytes:
        """E8 and four bytes that are a place in the file: turned back into a distance. The last ten bytes stay."""
        out, at = bytearray(made), 0
        while at < len(out) - 10:
            if out[at] != 0xE8:
                at += 1
                continue
            here, target = begin + at, int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            if -here <= target < self.translated:
                target += -here if target >= 0 else self.translated
                out[at + 1 : at + 5] = (target & 0xFFFFFFFF).to_bytes(4, "little")
            at += 5
        return bytes(out)


def decompress(data: bytes, size: int, window_bits: int, ends: list[int] | None = None, reset_every: int = 0) -> bytes:
    """``size`` bytes of a stream. ``ends``: where the data of each frame but the last ends; without them the data is one
    run of frames. The decoder is reset after every ``reset_every`` frames (0: never)."""
    decoder, out = Decoder(window_bits), bytearray()
    places = [0, *(ends or []), len(data)]
    for k, (a, b) in enumerate(zip(places, places[1:], strict=False)):
        if len(out) >= size:
            break
        if reset_every and k % reset_every == 0:
            decoder.reset()
        out += decoder.frame(data[a:b], min(FRAME if ends is not None else size, size - len(out)))
    return bytes(out)
