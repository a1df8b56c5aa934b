"""Context-mixing range coder for token ids, for many blocks at once.

A segment is a list of ids cut into blocks of equal length (the last may be
shorter). Every block starts from a fresh model and carries the CRC-32 of its
ids, so it can be decoded and checked on its own. All blocks of a segment, and of some
segments, are coded in step: a lane of every array belongs to one block, and step t
codes the t-th id of all blocks. A writer, which has all ids at hand, looks the predictions of
a whole stretch of blocks up at once; a reader learns them step by step.

Three predictions are mixed for each id: the id last seen after the last two ids
(order 2) and after the last one (order 1), each with a confidence, and the
frequencies of the block so far (order 0). A context made of both confidences
and whether the two agree holds their adaptive weights: the chances that order 2
is right, that order 1 is, or that neither is. The range coder codes which, and
after "neither" the id by order 0. Order-0 tables are summed up anew whenever the block has doubled.

Segment layout, little-endian: 4 bytes ``DKID``, then uint32 version, number of
ids, block length, alphabet size; the ids of the alphabet (uint32); for each
block the CRC-32 of its ids as uint32 and its number of 16-bit words; the words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"DKID"
VERSION = 1
BLOCK = 8192
LEAST_BLOCK = 1024
LANES = 1024  # wanted before blocks grow
TABLE = 1 << 23  # half the entries of the order-1 tables: bounds the lanes worked on at once
COUNTED = 1 << 18  # entries of the tables in which a writer counts symbols
AHEAD = 1 << 20  # ids whose predictions a writer looks up at once
STRETCH = 1 << 17  # ids whose weights and shares a writer holds at once
TOGETHER = 6_000_000  # ids of several segments that are coded in step
SLOT_BITS = 11  # of the order-2 table of a block
FIRST_SUM = 64
DENSE = 1 << 22  # ids below are ranked by a table
# Order 0 shares out a power of two, at least 2**14 and 4 for each id of the
# alphabet: 1 to each id, the rest by how often it has occurred.
LEAST_SHARES = 14
# Adaptive weights: 12 bits, moved by a 32nd of the distance to HIT or MISS.
WEIGHT_BITS, HIT, MISS, RATE = 12, 4080, 8, 5
U = np.uint64
# Arrays of no dimension, which numpy takes faster than its numbers.
ONE, WORD_SHIFT, WORD, TOP, WEIGHT_SHIFT = (np.array(x, U) for x in (1, 4, 16, 48, WEIGHT_BITS))
SETTLED = np.array(1 << 48, U)
# Left after every id, so 12 bits of weights and up to 20 of order 0 can follow.
LEAST_RANGE = np.array(1 << 42, U)


class Corrupt(ValueError):
    """A segment that does not hold what was written."""


class Coder:
    """Carry-less range coder, one 64-bit state for each lane, 16-bit words."""

    def __init__(self, lanes: int, words: list[np.ndarray] | None = None):
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, 2**64 - 1, U)
        self.reading = words is not None
        if words is None:
            self.written: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and a word of each
            self.lane_kind = np.uint16 if lanes <= 1 << 16 else np.uint32
        else:
            sizes = np.fromiter(map(len, words), np.int64, lanes)
            self.words = np.concatenate([*words, np.zeros(1, np.uint16)]).astype(np.uint16)
            self.ends = np.cumsum(sizes)
            self.at = self.ends - sizes
            self.code = np.zeros(lanes, U)
            for _ in range(4):
                self.code = (self.code << WORD) | self.next_words(np.arange(lanes))

    def next_words(self, who: np.ndarray) -> np.ndarray:
        at = self.at.take(who)
        self.at[who] = at + 1
        return self.words.take(at, mode="clip").astype(U)

    def check_ends(self) -> None:
        if (self.at != self.ends).any():
            raise Corrupt("a block does not end with its words")

    def write_words(self, who: np.ndarray, words: np.ndarray) -> None:
        self.written.append((who.astype(self.lane_kind), words.astype(np.uint16)))

    def settle(self, lanes: int) -> None:
        """Move words that are decided, until every range is wide enough."""
        low, span = self.low[:lanes], self.range[:lanes]
        moving = (low ^ (low + span)) < SETTLED
        who = ((span < LEAST_RANGE) > moving).nonzero()[0]
        if len(who):
            span[who] = (ONE + ~low.take(who)) & (LEAST_RANGE - ONE)
            moving[who] = True
        shift = moving.astype(U) << WORD_SHIFT  # by a word or not at all
        if self.reading:
            at, code = self.at[:lanes], self.code[:lanes]
            code <<= shift
            code |= self.words.take(at, mode="clip") * moving
            at += moving
        else:
            who = moving.nonzero()[0]
            self.write_words(who, low.take(who) >> TOP)
        low <<= shift
        span <<= shift
        who = (span < SETTLED).nonzero()[0]  # no other can have a second word
        while len(who):
            low, span = self.low.take(who), self.range.take(who)
            decided = (low ^ (low + span)) < SETTLED
            more = (decided | (span < LEAST_RANGE)).nonzero()[0]
            if not len(more):
                break
            who, low, span, decided = who.take(more), low.take(more), span.take(more), decided.take(more)
            if self.reading:
                self.code[who] = (self.code.take(who) << WORD) | self.next_words(who)
            else:
                self.write_words(who, low >> TOP)
            if not decided.all():
                span = np.where(decided, span, (ONE + ~low) & (LEAST_RANGE - ONE))
            span <<= WORD
            self.low[who], self.range[who] = low << WORD, span
            who = who[span < SETTLED]

    def finished(self) -> list[np.ndarray]:
        """The words of each lane; flushes the state."""
        lanes = len(self.low)
        for shift in (48, 32, 16, 0):
            self.write_words(np.arange(lanes), (self.low >> U(shift)) & U(0xFFFF))
        lane, words = (np.concatenate(x) for x in zip(*self.written))
        words = words[np.argsort(lane, kind="stable")]
        return np.split(words, np.cumsum(np.bincount(lane, minlength=lanes))[:-1])


# What the weights of order 2 and of order 1 move to where either was right, or none.
GOALS = np.array([[HIT, MISS], [MISS, HIT], [MISS, MISS]], np.int16).view(np.int32).reshape(-1)
SECOND_RIGHT, FIRST_RIGHT, NONE_RIGHT = (np.array(x) for x in GOALS)
# What a prediction's confidence rises by if it is wrong, and if it is right. One below 2
# that is wrong gives way.
RISES = np.array([0, 0, -1, -1, 1, 1, 1, 0])
HASH_BEFORE, HASH_LAST, HASH_SHIFT = 0x9E3779B1, 0x85EBCA77, 32 - SLOT_BITS
LAST_SLOT = (1 << SLOT_BITS) - 1


def share_bits(size: int) -> int:
    return max(LEAST_SHARES, int(size).bit_length() + 2)


def below(counts, symbols, seen: int, size: int):
    """Shares below each symbol, ``counts`` of the ``seen`` ids being smaller."""
    spare = (1 << share_bits(size)) - size
    return (counts * 16 + symbols) * spare // (16 * seen + size) + symbols


def first_weights(lanes: int) -> np.ndarray:
    """By confidences and agreement, in 4096ths: order 2 is right, order 1 is right. The
    two weights of a context lie side by side, moved as one 32-bit number."""
    trusts = [(b, a, same) for b in range(4) for a in range(4) for same in (0, 1)]
    weights = [(MISS + 600 * b, MISS + (0 if same else 300 * a)) for b, a, same in trusts]
    return np.repeat(np.array(weights, np.int16).view(np.int32), lanes)


def moved(weights: np.ndarray, goals: np.ndarray) -> np.ndarray:
    weights = weights.view(np.int16)
    return (weights + ((goals.view(np.int16) - weights) >> RATE)).view(np.int32)


class Model:
    """Predictions of each lane over an alphabet of its size, ``size`` at most.

    A prediction is its symbol times 4 and a confidence from 0 (none) to 3. Those of
    order 2 and of order 1 lie in one table, and in all arrays one behind the other.
    Tables have the lanes side by side: most lanes look at few places, which stay near.
    """

    def __init__(self, lanes: int, size: int, reading: bool, sizes: np.ndarray | None = None):
        self.reading = reading
        self.lanes, self.bits = lanes, share_bits(size)
        self.sizes = np.full(lanes, size) if sizes is None else sizes
        self.all_shares = np.fromiter((1 << share_bits(x) for x in self.sizes.tolist()), np.int64, lanes)
        self.kind = prediction_kind(size)
        self.row = np.arange(lanes)
        self.row1 = self.row + (lanes << SLOT_BITS)
        self.last = np.zeros(lanes, np.int64)
        self.before_last = np.zeros(lanes, np.int64)
        self.guesses = np.zeros((lanes << SLOT_BITS) + lanes * size, self.kind)
        self.one, self.two, self.three, self.four = (np.array(x, self.kind) for x in (1, 2, 3, 4))
        self.rises = RISES.astype(self.kind)
        self.weights = first_weights(lanes)
        self.steps, self.due = 0, FIRST_SUM
        if reading:
            self.sum_up(np.zeros((0, lanes), np.int32))

    def sum_up(self, seen: np.ndarray) -> None:
        """Order 0 after the symbols so far (steps x lanes): the different ones of each
        lane, in order, with their shares. Before each lane's stands one below all."""
        self.seen, lanes = len(seen), self.lanes
        ordered = np.array(seen.T, order="C")  # a copy, also of one lane
        ordered.sort(axis=1)
        new = np.ones(ordered.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        at = np.flatnonzero(new)
        lane, place = np.divmod(at, max(1, self.seen))
        after = np.where(np.r_[lane[1:] != lane[:-1], True][: len(at)], self.seen, np.r_[place[1:], 0][: len(at)])
        symbol = ordered.reshape(-1).take(at).astype(np.int64)
        self.spare, self.total = self.all_shares - self.sizes, 16 * self.seen + self.sizes
        spare, total = self.spare.take(lane), self.total.take(lane)
        start = (place * 16 + symbol) * spare // total + symbol
        stop = (after * 16 + symbol + 1) * spare // total + symbol + 1
        slots = np.arange(len(at)) + lane + 1
        kind = np.uint16 if max(self.bits, self.seen.bit_length()) < 16 else np.int32
        # no share reaches the next lane's
        self.start = np.full(len(at) + lanes + 1, 1 << self.bits, kind)
        self.start[slots] = start
        found = np.zeros((len(at) + lanes, 4), kind)
        for column, of_entry in enumerate((symbol, start, stop, after)):
            found[slots, column] = of_entry
        # 8 or 16 bytes that are taken at once
        self.entries = found.view(np.uint64 if kind == np.uint16 else np.complex128).reshape(-1)
        # For each stretch of shares, the last symbol that starts before it. No symbol seen
        # has fewer shares than a stretch, so at most one starts inside.
        self.shift = int((17 * self.spare // self.total + 1).min()).bit_length() - 1
        depth = max(0, self.bits - self.shift)
        starts = np.zeros((lanes, 1 << depth), kind)
        starts.reshape(-1)[(lane << depth) + (start >> self.shift)] = 1
        self.nearest = (np.cumsum(starts, axis=1, dtype=kind) - starts).reshape(-1)
        self.row_stretch = np.arange(lanes) << depth
        counts = np.bincount(lane, minlength=lanes)
        self.row_entry = np.cumsum(counts) - counts + np.arange(lanes)

    def find(self, point: np.ndarray) -> np.ndarray:
        """By order 0, the symbol that has a share of each of the first lanes, and the
        shares where its own start and stop."""
        return self.entry(slice(len(point)), point)

    def entry(self, lane: slice | np.ndarray, point: np.ndarray) -> np.ndarray:
        at = self.row_entry[lane] + self.nearest.take(self.row_stretch[lane] + (point >> self.shift))
        at += self.start.take(at + 1) <= point
        found = self.entries.take(at).view(self.start.dtype).reshape(-1, 4).T.astype(np.int64)
        unseen = (point >= found[2]).nonzero()[0]
        if len(unseen):
            spare, total = self.spare[lane].take(unseen), self.total[lane].take(unseen)
            smaller = found[3].take(unseen) * (16 * spare)
            found[0, unseen] = symbol = ((point.take(unseen) + 1) * total - (smaller + 1)) // (spare + total)
            smaller += symbol * spare
            found[1, unseen] = smaller // total + symbol
            found[2, unseen] = (smaller + spare) // total + symbol + 1
        return found[:3]

    @property
    def owner(self) -> np.ndarray:
        """The symbol of every share, lane by lane, as it is found."""
        if not self.reading:
            raise AttributeError("a model that writes does not look for owners")
        lane = np.repeat(self.row, self.all_shares)
        return self.entry(lane, np.concatenate([np.arange(x) for x in self.all_shares]))[0]

    def contexts(self, lanes: int) -> None:
        """Looks up the predictions for the next id of the first ``lanes`` lanes."""
        last, row = self.last[:lanes], self.row[:lanes]
        self.place = np.empty(2 * lanes, np.int64)
        slot = ((self.before_last[:lanes] * HASH_BEFORE + last * HASH_LAST) >> HASH_SHIFT) & LAST_SLOT
        np.add(slot * self.lanes, row, out=self.place[:lanes])
        np.add(last * self.lanes, self.row1[:lanes], out=self.place[lanes:])
        self.found = found = self.guesses.take(self.place)
        trust, self.guess = found & self.three, found >> self.two
        self.second, self.first = self.guess[:lanes], self.guess[lanes:]
        context = (trust[:lanes] << self.three) + (trust[lanes:] << self.one) + (self.first == self.second)
        self.context = row + context.astype(np.int64) * self.lanes
        self.weight = self.weights.take(self.context)

    def learn(self, lanes: int, symbols: np.ndarray, goals: np.ndarray) -> None:
        self.weights[self.context] = moved(self.weight, goals)
        found, now = self.found, np.empty(2 * lanes, self.kind)
        now[:lanes] = (symbols << 2) + 1
        now[lanes:] = now[:lanes]
        right = (now ^ found) < self.four
        # Few are right or kept though wrong; the others give way to the symbol.
        few = np.logical_or(right, found & self.two).nonzero()[0]
        if len(few):
            kept = found.take(few)
            now[few] = kept + self.rises.take((kept & self.three) + (right.take(few) * self.four))
        self.guesses[self.place] = now
        self.before_last[:lanes] = self.last[:lanes]
        self.last[:lanes] = symbols
        self.steps += 1


def prediction_kind(size: int) -> type:
    return np.uint16 if size < 1 << 14 else np.uint32


def predictions(places: np.ndarray, symbols: np.ndarray, kind: type) -> np.ndarray:
    """What a table of predictions holds at the place of each step (lanes x steps) when it
    comes up: at once for all places that come up for the n-th time."""
    lanes, steps = symbols.shape
    order = np.argsort(places, axis=1, kind="stable")
    order += (np.arange(lanes) * steps)[:, None]
    order = order.reshape(-1)
    place = places.reshape(-1).take(order)
    new = np.ones(len(order), bool)
    new[1:] = place[1:] != place[:-1]
    new[::steps] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(order)])
    still = np.cumsum(np.bincount(sizes)[::-1])[::-1].tolist()  # places of at least as many steps
    again = sizes > 1
    shorter = (steps - sizes[again]).astype(np.uint16 if steps < 1 << 16 else np.uint32)
    starts = starts[again].take(np.argsort(shorter, kind="stable"))
    fresh = (symbols * 4 + 1).astype(kind).reshape(-1).take(order)
    found = np.zeros(len(order), kind)
    held, rises = fresh.take(starts), RISES.astype(kind)
    for nth in range(1, len(still) - 1):
        at = starts[: still[nth + 1]] + nth
        kept, now = held[: len(at)], fresh.take(at)
        found[at] = kept
        right = (kept ^ now) < 4
        few = np.logical_or(right, kept & kind(2)).nonzero()[0]
        kept, held = kept.take(few), now
        held[few] = kept + rises.take((kept & kind(3)) + right.take(few) * kind(4))
    out = np.empty(len(order), kind)
    out[order] = found
    return out.reshape(lanes, steps)


def order_0(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the symbols (lanes x steps), the shares below it and its own when it
    is coded: after the steps before the last power of two from FIRST_SUM on."""
    lanes, steps = symbols.shape
    kind = np.uint32 if (16 * steps + size) << share_bits(size) < 1 << 32 else np.int64
    under, own = np.empty((lanes, steps), np.uint32), np.empty((lanes, steps), np.uint32)
    rows = (np.arange(lanes) * size)[:, None]
    begin = 0
    while begin < steps:
        end = min(max(FIRST_SUM, 2 * begin), steps)
        asked = symbols[:, begin:end].astype(kind)
        if begin:
            counts = np.bincount((rows + symbols[:, :begin]).reshape(-1), minlength=lanes * size)
            places = rows + symbols[:, begin:end]
            smaller = (np.cumsum(counts).take(places) - (np.arange(lanes) * begin)[:, None]).astype(kind)
            counts = counts.take(places).astype(kind)
        else:
            smaller = counts = np.zeros_like(asked)
        start = below(smaller - counts, asked, begin, size)
        under[:, begin:end] = start
        own[:, begin:end] = below(smaller, asked + kind(1), begin, size) - start
        begin = end
    return under, own


class Ahead:
    """What a writer knows of a segment's blocks (blocks x steps) before it codes them. What
    a shorter block is filled up with is worked out, too, but not coded."""

    def __init__(self, symbols: np.ndarray, size: int):
        lanes, steps = symbols.shape
        kind = prediction_kind(size)
        self.bits = share_bits(size)
        self.contexts, self.goals = np.empty((steps, lanes), np.uint8), np.empty((steps, lanes), np.uint8)
        self.shares = np.empty((2, steps, lanes), np.uint32)
        group = max(1, AHEAD // steps)
        for a in range(0, lanes, group):
            asked = symbols[a : a + group]
            last, before = (np.zeros(asked.shape, np.int64) for _ in range(2))
            last[:, 1:], before[:, 2:] = asked[:, :-1], asked[:, :-2]
            slot = (((before * HASH_BEFORE + last * HASH_LAST) >> HASH_SHIFT) & LAST_SLOT).astype(np.uint16)
            second = predictions(slot, asked, kind)
            first = predictions(last.astype(np.uint16 if size <= 1 << 16 else np.uint32), asked, kind)
            guess2, guess1 = second >> kind(2), first >> kind(2)
            context = ((second & kind(3)) << kind(3)) + ((first & kind(3)) << kind(1)) + (guess1 == guess2)
            self.contexts[:, a : a + group] = context.T
            self.goals[:, a : a + group] = ((guess2 != asked) * (np.uint8(2) - (guess1 == asked))).T
        group = max(1, min(STRETCH // steps, COUNTED // size))
        for a in range(0, lanes, group):
            for of_all, found in zip(self.shares, order_0(symbols[a : a + group], size)):
                of_all[:, a : a + group] = found.T


def write(coder: Coder, aheads: list[Ahead], lengths: np.ndarray, order: np.ndarray) -> None:
    """Code the blocks; ``order`` has them with the longer ones first."""
    lengths = lengths[order]
    lanes = len(order)
    weights, row = first_weights(lanes), np.arange(lanes)
    all_bits = np.repeat([x.bits for x in aheads], [x.goals.shape[1] for x in aheads])[order].astype(U)
    stretch = max(1, STRETCH // lanes)

    def laid(parts: list[np.ndarray]) -> np.ndarray:
        """A stretch of all blocks, side by side; zeros where a segment is over."""
        steps = max(map(len, parts))
        out = [np.pad(x, ((0, steps - len(x)), (0, 0))) if len(x) < steps else x for x in parts]
        return np.concatenate(out, axis=1).take(order, axis=1)

    for a in range(0, int(lengths[0]), stretch):
        here = slice(a, a + stretch)
        goal = laid([x.goals[here] for x in aheads])
        at = row + laid([x.contexts[here] for x in aheads]).astype(np.int64) * lanes
        weight = np.empty(at.shape, np.int32)
        for place, aim, found in zip(at, GOALS.take(goal), weight):
            weights.take(place, out=found, mode="clip")
            weights[place] = moved(found, aim)
        weight2, weight1 = weight.view(np.int16)[:, 0::2], weight.view(np.int16)[:, 1::2]
        plain = goal == 2
        # From start to stop, then of that, unless it was predicted, the order-0 shares.
        start = (weight2 * (goal > 0) + weight1 * plain).astype(U)
        width = np.where(plain, (1 << WEIGHT_BITS) - weight2 - weight1, np.where(goal, weight1, weight2)).astype(U)
        bits = plain * all_bits
        under = (laid([x.shares[0, here] for x in aheads]) * plain).astype(U)
        own = np.where(plain, laid([x.shares[1, here] for x in aheads]), np.uint32(1)).astype(U)
        for t in range(len(goal)):
            n = lanes if lengths[-1] > a + t else int(np.searchsorted(-lengths, -a - t))
            low, span = coder.low[:n], coder.range[:n]
            span >>= WEIGHT_SHIFT
            low += span * start[t, :n]
            span *= width[t, :n]
            span >>= bits[t, :n]
            low += span * under[t, :n]
            span *= own[t, :n]
            coder.settle(n)


def read(model: Model, coder: Coder, symbols: np.ndarray, lengths: np.ndarray) -> None:
    """Fill ``symbols`` (steps x blocks) in. Longer blocks come first."""
    last_share = (model.all_shares - 1).astype(U)
    bits = np.array([share_bits(x) for x in model.sizes.tolist()], U)
    nothing, unpredicted = np.array(0, U), np.full(model.lanes, NONE_RIGHT)
    for t in range(int(lengths[0])):
        lanes = model.lanes if lengths[-1] > t else int(np.searchsorted(-lengths, -t))
        model.contexts(lanes)
        weight = model.weight.view(np.int16)
        low, span = coder.low[:lanes], coder.range[:lanes]
        unit = span >> WEIGHT_SHIFT
        start, stop = unit * (weight[0::2] + weight[1::2]).astype(U), unit << WEIGHT_SHIFT
        point = coder.code[:lanes] - low
        goals = unpredicted[:lanes].copy()
        who = (point < start).nonzero()[0]  # predicted
        if len(who):
            ends = start.take(who)
            middle = unit.take(who) * weight[0::2].take(who).astype(U)
            by_second = point.take(who) < middle
            start[who] = np.where(by_second, nothing, middle)
            stop[who] = np.where(by_second, middle, ends)
            goals[who] = np.where(by_second, SECOND_RIGHT, FIRST_RIGHT)
            guess = np.where(by_second, model.second.take(who), model.first.take(who))
        low += start
        np.subtract(stop, start, out=span)
        unit = span >> bits[:lanes]
        point -= start
        point //= unit
        now, start, stop = model.find(np.minimum(point, last_share[:lanes]).view(np.int64))
        if len(who):
            now[who], start[who], kept = guess, 0, span.take(who)
        np.multiply(unit, (stop - start).astype(U), out=span)
        low += unit * start.astype(U)
        if len(who):
            span[who] = kept
        symbols[t, :lanes] = now
        coder.settle(lanes)
        model.learn(lanes, now, goals)
        if model.steps == model.due:
            model.due *= 2
            model.sum_up(symbols[: model.steps])
    coder.check_ends()


def lane_groups(n_blocks: int, size: int) -> list[slice]:
    step = max(1, 2 * TABLE // max(1, size))
    return [slice(a, min(a + step, n_blocks)) for a in range(0, n_blocks, step)]


def block_length(n_ids: int) -> int:
    return int(min(BLOCK, max(LEAST_BLOCK, -(-n_ids // LANES))))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and the place of each id among them."""
    if not len(ids) or int(ids.max()) >= DENSE:
        return np.unique(ids, return_inverse=True)
    met = np.zeros(int(ids.max()) + 1, bool)
    met[ids] = True
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - np.int32(1))[ids]


def lengths_of(n_ids: int, length: int) -> np.ndarray:
    """Of the blocks."""
    lengths = np.full(-(-n_ids // length), length)
    if n_ids:
        lengths[-1] = n_ids - (len(lengths) - 1) * length
    return lengths


def encode_segment(ids: np.ndarray) -> bytes:
    """The ids, non-negative and below 2**32, as one segment."""
    return encode_segments([ids])[0]


def encode_segments(segments: list[np.ndarray]) -> list[bytes]:
    """Each as ``encode_segment`` has it; ``TOGETHER`` ids are coded in step."""
    heads, pieces = [], []
    for ids in map(np.asarray, segments):
        length = block_length(len(ids))
        alphabet, symbols = ranked(ids)
        lengths = lengths_of(len(ids), length)
        sums = [checksum(ids[i * length : (i + 1) * length]) for i in range(len(lengths))]
        heads.append((np.array([VERSION, len(ids), length, len(alphabet)], "<u4"), alphabet, sums))
        padded = np.zeros(len(lengths) * length, np.int32)
        padded[: len(ids)] = symbols
        blocks, step = padded.reshape(len(lengths), length), max(1, TOGETHER // length)
        for a in range(0, len(lengths), step):
            pieces.append((blocks[a : a + step, : lengths[a]], lengths[a : a + step], len(alphabet)))
    words: list[np.ndarray] = []
    waiting: list = []
    for piece in pieces:
        if waiting and sum(x.size for x, _, _ in [*waiting, piece]) > TOGETHER:
            words += words_of(waiting)
            waiting = []
        waiting.append(piece)
    if waiting:
        words += words_of(waiting)
    out, first = [], 0
    for head, alphabet, sums in heads:
        own = words[first : first + len(sums)]
        first += len(sums)
        index = np.array([(s, len(w)) for s, w in zip(sums, own)], "<u4").reshape(-1, 2)
        parts = [head, alphabet.astype("<u4"), index, *(w.astype("<u2") for w in own)]
        out.append(MAGIC + b"".join(x.tobytes() for x in parts))
    return out


def words_of(pieces: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """The words of each block of pieces of segments: blocks, their lengths, alphabet size."""
    lengths = np.concatenate([x for _, x, _ in pieces])
    order = np.argsort(-lengths, kind="stable")
    coder = Coder(len(order))
    write(coder, [Ahead(blocks, size) for blocks, _, size in pieces], lengths, order)
    written = coder.finished()
    return [written[i] for i in np.argsort(order)]


class Segment:
    """The parts of a segment's bytes; raises Corrupt unless they fit together."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise Corrupt("not a segment")
        version, self.n_ids, self.length, self.size = np.frombuffer(data, "<u4", 4, 4).tolist()
        if version != VERSION:
            raise Corrupt(f"version {version}")
        self.alphabet = np.frombuffer(data, "<u4", self.size, 20).astype(np.int64)
        self.lengths = lengths_of(self.n_ids, self.length)
        at = 20 + 4 * self.size
        index = np.frombuffer(data, "<u4", 2 * len(self.lengths), at).reshape(-1, 2)
        at += 8 * len(self.lengths)
        self.sums, sizes = index[:, 0].tolist(), index[:, 1].astype(np.int64)
        if len(data) != at + 2 * int(sizes.sum()):
            raise Corrupt("wrong size")
        stream = np.frombuffer(data, "<u2", -1, at)
        self.words = np.split(stream, np.cumsum(sizes)[:-1]) if self.n_ids else []

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        ids = self.alphabet[symbols.reshape(-1)[: self.n_ids]]
        for i, wanted in enumerate(self.sums):
            if checksum(ids[i * self.length : (i + 1) * self.length]) != wanted:
                raise Corrupt(f"block {i} has another checksum")
        return ids


def decode_segment(data: bytes) -> np.ndarray:
    """The ids; raises Corrupt unless every block has its checksum."""
    return decode_segments([data])[0]


def decode_segments(all_data: list[bytes]) -> list[np.ndarray]:
    """Each as ``decode_segment`` has it, all decoded in step."""
    segments = [Segment(data) for data in all_data]
    lengths = np.concatenate([np.zeros(0, np.int64), *(x.lengths for x in segments)])
    sizes = np.repeat([x.size for x in segments], [len(x.lengths) for x in segments])
    words = [w for x in segments for w in x.words]
    order = np.argsort(-lengths, kind="stable")
    symbols = np.zeros((len(order), int(lengths.max(initial=0))), np.int32)
    for part in lane_groups(len(order), int(sizes.max(initial=0))):
        who = order[part]
        coder = Coder(len(who), [words[i] for i in who])
        found = np.zeros((int(lengths[who[0]]), len(who)), np.int32)
        read(Model(len(who), int(sizes[who].max()), True, sizes[who]), coder, found, lengths[who])
        symbols[who, : len(found)] = found.T
    out, first = [], 0
    for x in segments:
        n_blocks = len(x.lengths)
        out.append(x.ids(symbols[first : first + n_blocks, : x.length if n_blocks > 1 else x.n_ids]))
        first += n_blocks
    return out
