"""Bit planes of a segment as adaptive, interleaved variable-length code words, and back.

One walk over the pixels serves both ways: a Writer is given each bit, a Reader finds it. Each bit has a context from
its neighbours, a context has counts, and counts choose one of 17 bins. A bin collects bits until they are one of its
inputs; the word for it keeps the place it had when its first bit came. Words leave in that order; if the oldest of
RING words still waits for bits, it is filled up with the fewest, smallest bits that end it. Word bits are packed from the low bit of each byte up.
"""

RING, CAP, PLANES = 2048, 500, 9
LL, HL, LH, HH = range(4)

#: Contexts by significant neighbours (horizontal, vertical, diagonal), for LL, LH and, transposed, HL.
ZERO_CONTEXT = [
    [[0, 1, 2, 2, 2], [3, 3, 3, 3, 3], [4, 4, 4, 4, 4]],
    [[5, 6, 7, 7, 7], [7, 7, 7, 7, 7], [7, 7, 7, 7, 7]],
    [[8, 8, 8, 8, 8], [8, 8, 8, 8, 8], [8, 8, 8, 8, 8]],
]
#: For HH, by horizontal and vertical together, then diagonal.
ZERO_CONTEXT_HH = [[0, 3, 6, 8, 8], [1, 4, 7, 8, 8], [2, 5, 7, 8, 8], [2, 5, 7, 8, 8], [2, 5, 7, 8, 8]]
#: Contexts and predictions (1: negative) of signs, by negative neighbours: two, one or none, horizontal then vertical.
SIGN_CONTEXT = [[14, 14, 15], [14, 14, 15], [13, 13, 12]]
SIGN_GUESS = [[1, 1, 1], [1, 1, 1], [0, 0, 0]]
#: The least probability of zero in each bin after the first, in 65536ths.
CUTOFFS = [35298, 37345, 40503, 43591, 47480, 50133, 53645, 55902, 57755, 58894, 60437, 62267, 63613, 64557, 65134, 65392]
#: Run lengths of the Golomb bins, 9 to 17.
GOLOMB = [5, 6, 7, 11, 17, 31, 70, 200, 512]
#: Words of bins 2 to 8, input to output, both with the first bit last.
WORDS = [
    {"01": "10", "011": "011", "0111": "1111", "1111": "10000", "10": "01", "100": "100", "1000": "1000", "10000": "00000", "00000": "0111"},
    {"10": "01", "100": "00", "0000": "011", "11000": "10010", "01000": "1111", "01": "110", "0011": "0111", "1011": "00010", "111": "1010"},
    {"10": "10", "100": "011", "000": "00", "01": "01", "11": "111"},
    {"00": "1", "010": "000", "110": "1010", "101": "0010", "1001": "1110", "00001": "0100", "10001": "00110", "011": "1100", "111": "10110"},
    {"1": "10", "010": "011", "110": "1111", "100": "101", "1000": "001", "10000": "0111", "00000": "00"},
    {"000": "0", "100": "001", "010": "101", "110": "01111", "11": "0111", "001": "011", "101": "11111"},
    {"10": "101", "100": "001", "0000": "0", "01000": "0111", "11000": "01111", "01": "011", "11": "11111"},
]


def _golomb(run: int) -> dict[tuple[int, ...], str]:
    """Inputs, in order of their bits: a whole run of zeros, or fewer and a one. Shorter runs have shorter words."""
    width = (run - 1).bit_length()
    spare = (1 << width) - run
    words = {(0,) * run: "1"}
    for k in range(run):
        words[(0,) * k + (1,)] = format(k, f"0{width}b") if k < spare else format(k + spare, f"0{width + 1}b")
    return words


#: Of each bin, inputs in order of their bits, with words in order of theirs.
CODES = [{(0,): "0", (1,): "1"}, *[{tuple(map(int, a[::-1])): b[::-1] for a, b in w.items()} for w in WORDS], *map(_golomb, GOLOMB)]


def _fillers(inputs) -> dict[tuple[int, ...], tuple[int, ...]]:
    """Of each unfinished input the shortest, then smallest (first bit last) bits that end it."""
    best: dict = {}
    for whole in inputs:
        for n in range(1, len(whole)):
            rest = whole[n:]
            known = best.get(whole[:n])
            if known is None or (len(rest), rest[::-1]) < (len(known), known[::-1]):
                best[whole[:n]] = rest
    return best


class _Trie:
    """A walk from bit to bit: state * 2 + bit gives the next state, or the word at a whole input (then next is 0)."""

    def __init__(self, inputs):
        self.next, self.end, states = [0, 0], [None, None], {(): 0}
        for whole, word in inputs.items():
            for n in range(1, len(whole) + 1):
                at = states[whole[: n - 1]] * 2 + whole[n - 1]
                if n == len(whole):
                    self.end[at] = word
                elif whole[:n] not in states:
                    self.next[at] = states[whole[:n]] = len(self.next) // 2
                    self.next += [0, 0]
                    self.end += [None, None]
        self.states = states


_IN = [_Trie(c) for c in CODES]
_FILL = [{t.states[a]: c[a + b] for a, b in _fillers(c).items()} for t, c in zip(_IN, CODES)]
_OUT = [_Trie({tuple(map(int, w)): a for a, w in c.items()}) for c in CODES]


def bin_of(zeros: int, total: int) -> int:
    """The last bin whose least probability of zero is reached, from 0."""
    k, share = 0, zeros << 16
    while k < len(CUTOFFS) and share >= total * CUTOFFS[k]:
        k += 1
    return k


class Writer:
    def __init__(self):
        self.words: list = []  # of each word its bits, or [bin, state] while it waits
        self.head, self.open = 0, [None] * len(CODES)

    def _fill(self, i: int):
        k, state = self.words[i]
        self.words[i] = _FILL[k][state]
        self.open[k] = None

    def bit(self, bit: int, zeros: int, total: int) -> int:
        if zeros < total >> 1:
            zeros, b = total - zeros, bit ^ 1
        else:
            b = bit
        k = bin_of(zeros, total)
        i = self.open[k]
        words = self.words
        if i is None:
            while self.head < len(words) and isinstance(words[self.head], str):
                self.head += 1
            if len(words) - self.head >= RING:
                self._fill(self.head)
            i = self.open[k] = len(words)
            words.append([k, 0])
        at = words[i][1] * 2 + b
        word = _IN[k].end[at]
        if word is None:
            words[i][1] = _IN[k].next[at]
        else:
            words[i], self.open[k] = word, None
        return bit

    def done(self) -> tuple[bytes, int]:
        """The payload and its number of bits."""
        for i in range(self.head, len(self.words)):
            if not isinstance(self.words[i], str):
                self._fill(i)
        bits = "".join(self.words)
        return int(bits[::-1] or "0", 2).to_bytes((len(bits) + 7) // 8, "little"), len(bits)


class Reader:
    """Gives the bits back; EOFError where the payload ends too early."""

    def __init__(self, payload: bytes, n_bits: int):
        self.bits = format(int.from_bytes(payload, "little"), f"0{max(1, 8 * len(payload))}b")[::-1][:n_bits]
        self.at, self.read = 0, 0
        self.left: list = [()] * len(CODES)
        self.place, self.since = [0] * len(CODES), [0] * len(CODES)

    def bit(self, _, zeros: int, total: int) -> int:
        flip = zeros < total >> 1
        k = bin_of(total - zeros if flip else zeros, total)
        if self.place[k] >= len(self.left[k]) or self.read - self.since[k] >= RING:
            state, out = 0, _OUT[k]
            while True:
                if self.at >= len(self.bits):
                    raise EOFError("payload cut short")
                step = state * 2 + (self.bits[self.at] == "1")
                self.at += 1
                if out.end[step] is not None:
                    break
                state = out.next[step]
                if not state:
                    raise EOFError("no such word")
            self.left[k], self.place[k] = out.end[step], 0
            self.read += 1
            self.since[k] = self.read
        b = self.left[k][self.place[k]]
        self.place[k] += 1
        return b ^ 1 if flip else b


def code_plane(coder, mags: list[int], negs: list[int], w: int, h: int, lsb: int, subband: int) -> None:
    """Writes plane lsb of the segment, or reads it into mags and negs. Of both, planes above lsb must be there."""
    zero, total = [2] * 17, [4] * 17
    bit, wide = coder.bit, w + 2

    def adapt(c, b):
        total[c] += 1
        zero[c] += not b
        if total[c] >= CAP:
            total[c] >>= 1
            if zero[c] > total[c]:
                zero[c] >>= 1

    # with a border; a pixel passed counts with this plane, one to come with those above
    sig, minus = [0] * (wide * (h + 2)), [0] * (wide * (h + 2))
    for y in range(h):
        for x in range(w):
            if mags[y * w + x] >> (lsb + 1):
                sig[(y + 1) * wide + x + 1], minus[(y + 1) * wide + x + 1] = 1, negs[y * w + x]
    for y in range(h):
        p, q = (y + 1) * wide, y * w - 1
        for x in range(w):
            p += 1
            q += 1
            above, own = mags[q] >> (lsb + 1), (mags[q] >> lsb) & 1
            if above >= 4:
                b = bit(own, 1, 2)
            else:
                across, down = sig[p - 1] + sig[p + 1], sig[p - wide] + sig[p + wide]
                if above >= 2:
                    c = 11
                elif above:
                    c = 10 if across + down else 9
                else:
                    diagonal = sig[p - wide - 1] + sig[p - wide + 1] + sig[p + wide - 1] + sig[p + wide + 1]
                    if subband == HH:
                        c = ZERO_CONTEXT_HH[across + down][diagonal]
                    else:
                        c = ZERO_CONTEXT[down][across][diagonal] if subband == HL else ZERO_CONTEXT[across][down][diagonal]
                b = bit(own, zero[c], total[c])
                adapt(c, b)
                if b and not above:
                    i, j = 2 - minus[p - 1] - minus[p + 1], 2 - minus[p - wide] - minus[p + wide]
                    if subband == HL:
                        i, j = j, i
                    c, guess = SIGN_CONTEXT[i][j], SIGN_GUESS[i][j]
                    off = bit(guess ^ negs[q], zero[c], total[c])
                    adapt(c, off)
                    negs[q] = guess ^ off
                    sig[p], minus[p] = 1, negs[q]
            if b:
                mags[q] |= 1 << lsb


def encode_segment(values: list[int], w: int, h: int, subband: int, planes: int = PLANES) -> list[tuple[int, bytes, int]]:
    """(plane, payload, bits) from the top plane down. ValueError if a value needs more planes."""
    mags, negs = [abs(v) for v in values], [int(v < 0) for v in values]
    if max(mags, default=0) >> planes:
        raise ValueError("INTEGER_OVERFLOW: a coefficient needs more planes")
    out = []
    for lsb in range(planes - 1, -1, -1):
        coder = Writer()
        code_plane(coder, mags, negs, w, h, lsb, subband)
        out.append((lsb, *coder.done()))
    return out


def decode_segment(found: dict[int, tuple[bytes, int]], w: int, h: int, subband: int, planes: int = PLANES) -> list[int]:
    """Values from the planes found, from the top one down to the first that is missing or broken."""
    mags, negs = [0] * (w * h), [0] * (w * h)
    for lsb in range(planes - 1, -1, -1):
        if lsb not in found:
            break
        try:
            code_plane(Reader(*found[lsb]), mags, negs, w, h, lsb, subband)
        except EOFError:
            break
    return [-m if n else m for m, n in zip(mags, negs)]
