"""Segmentation lattices over an existing subword vocabulary, for many strings at once.

Strings are laid end to end as one array of code points. Every place of the
array walks the vocabulary's trie in step with all others, which gives the
edges (start, length, piece) of all lattices. Sums over segmentations run place
by place through all strings at once, in log space.

Spaces are written as U+2581 in the vocabulary. A character of which the
vocabulary has no piece has one edge, its UTF-8 bytes as byte pieces; so has
U+2581 itself where a text holds it, which keeps decoding exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
SPACE_CODE = ord(SPACE)
# Stands for U+2581 in a text; no trie has it.
LITERAL_SPACE = 0x110000
CODES = 1 << 21
BYTE = -1
WORD = r"[^\W_]"
SIGN = r"(?:_|[^\w \n])"
BYTE_PIECE = re.compile(r"^<0x([0-9A-F]{2})>$")


@dataclass(frozen=True)
class Vocabulary:
    """A trie in arrays: ``keys`` (state * CODES + code point) in a hash table with
    linear probing, ``child`` the state each leads to, ``piece`` the id that a
    state completes, or -1."""

    size: int
    ranks: np.ndarray  # merge rank of each id; bytes rank last
    byte_ids: np.ndarray  # id of each of the 256 byte pieces
    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    units: str  # regular expression of stretches that no piece leaves

    def next_states(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each code point, -1 where the trie ends."""
        wanted = states * CODES + codes
        slot = first_slots(wanted, len(self.keys))
        found = self.keys.take(slot)
        hit = found == wanted
        out = np.where(hit, self.child.take(slot), -1)
        lost = np.flatnonzero(~hit & (found >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[lost]]
            hit = found == wanted[lost]
            out[lost[hit]] = self.child[slot[lost[hit]]]
            lost = lost[~hit & (found >= 0)]
        return out

    def parts(self) -> tuple:
        """For a broadcast: ``Vocabulary(*parts)`` is the same again."""
        return (self.size, self.ranks, self.byte_ids, self.keys, self.child, self.piece, self.units)

    def zipf_weights(self, offset: float = 2.7) -> np.ndarray:
        """log probabilities by rank. The scores of the file are merge ranks, not
        logarithms of probabilities; Zipf's law gives those."""
        weights = -np.log(self.ranks + offset)
        return weights - np.logaddexp.reduce(weights)


def first_slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where probing starts in a table of ``size``, a power of two."""
    with np.errstate(over="ignore"):
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def unit_pattern(pieces: list[str]) -> str:
    """Spaces with the run of letters and digits or of signs behind them, or a
    line break. Runs stay together where a piece holds the pair of characters
    that meets there."""
    word = re.compile(WORD)
    pairs = {
        (a, b)
        for name in pieces
        for a, b in zip(name, name[1:])
        if SPACE not in (a, b) and bool(word.match(a)) != bool(word.match(b))
    }
    runs = f"(?:{WORD}+|{SIGN}+)"
    bridges = "|".join(f"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in sorted(pairs))
    return f" *{runs}" + (f"(?:(?:{bridges}){runs})*" if pairs else "") + r"|\n| +"


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model file with byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int64)
    ranks = np.full(size, float(size))
    names: list[str] = []
    transitions: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(BYTE_PIECE.match(name)[1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ranks[i] = -model.get_score(i)
            names.append(name)
            state = 0
            for c in name:
                state = transitions.setdefault((state, ord(c)), len(transitions) + 1)
            ends[state] = i
    made = np.array([s * CODES + c for s, c in transitions], np.int64)
    slots = 1 << (4 * len(made)).bit_length()
    keys, child = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64)
    for key, slot, state in zip(made.tolist(), first_slots(made, slots).tolist(), transitions.values()):
        while keys[slot] >= 0:
            slot = (slot + 1) & (slots - 1)
        keys[slot], child[slot] = key, state
    piece = np.full(len(transitions) + 1, -1, np.int64)
    piece[list(ends)] = list(ends.values())
    return Vocabulary(size, ranks, byte_ids, keys, child, piece, unit_pattern(names))


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points end to end, and the bounds of each string."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    data = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32).astype(np.int64), np.r_[0, np.cumsum(lengths)]


@dataclass
class Edges:
    """Sorted by start, long ones first. ``piece`` is -1 for a character written as bytes."""

    start: np.ndarray
    stop: np.ndarray
    piece: np.ndarray


def find_edges(vocabulary: Vocabulary, codes: np.ndarray, bounds: np.ndarray) -> Edges:
    n = len(codes)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at, state, length = np.arange(n), np.zeros(n, np.int64), 0
    covered = np.zeros(n, bool)
    # shortest first; placed from the longest, as long pieces are mostly taken
    starts, stops, pieces = [], [], []
    while len(at):
        state = vocabulary.next_states(state, codes.take(at + length))
        goes_on = np.flatnonzero(state >= 0)
        at, state = at.take(goes_on), state.take(goes_on)
        length += 1
        piece = vocabulary.piece.take(state)
        is_piece = np.flatnonzero(piece >= 0)
        starts.append(at.take(is_piece))
        stops.append(starts[-1] + length)
        pieces.append(piece.take(is_piece))
        if length == 1:
            covered[starts[-1]] = True
        inside = np.flatnonzero(at + length < ends.take(at))
        at, state = at.take(inside), state.take(inside)
    bare = np.flatnonzero(~covered)
    starts.insert(0, bare)
    stops.insert(0, bare + 1)
    pieces.insert(0, np.full(len(bare), BYTE))
    counts = np.bincount(np.concatenate(starts), minlength=n)
    # Where the next edge of each start goes; a start has one edge of each length.
    place = np.cumsum(counts) - counts
    start = np.repeat(np.arange(n), counts)
    stop, piece = np.empty_like(start), np.empty_like(start)
    for begin, end, found in zip(reversed(starts), reversed(stops), reversed(pieces)):
        at = place.take(begin)
        stop[at], piece[at] = end, found
        place[begin] = at + 1
    return Edges(start, stop, piece)


def bytes_of(code: int) -> bytes:
    return (SPACE if code == LITERAL_SPACE else chr(code)).encode("utf-8", "surrogatepass")


def edge_weights(
    vocabulary: Vocabulary, codes: np.ndarray, edges: Edges, weights: np.ndarray
) -> np.ndarray:
    """log weight of each edge; byte pieces of a character are multiplied."""
    out = weights[edges.piece]
    bare = np.flatnonzero(edges.piece == BYTE)
    if len(bare):
        kinds, which = np.unique(codes[edges.start[bare]], return_inverse=True)
        sums = [weights[vocabulary.byte_ids[list(bytes_of(int(c)))]].sum() for c in kinds]
        out[bare] = np.array(sums)[which]
    return out


def path_sums(
    bounds: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray
) -> np.ndarray:
    """log sum over all paths that end at each node, from each string's first node.

    Nodes are places, and one more after each string: place p of string i is node
    p + i. The recursion runs forward by distance from the string's first node;
    pass reversed edges for the backward one.
    """
    lengths = np.diff(bounds)
    first = bounds[:-1] + np.arange(len(lengths))
    sums = np.full(int(bounds[-1]) + len(lengths), -np.inf)
    sums[first] = 0.0
    distance = np.arange(len(sums)) - np.repeat(first, lengths + 1)
    # Edges come string by string, and a string has one node at each distance, so
    # this groups them by target; 16-bit keys are sorted without comparisons.
    most = int(lengths.max(initial=0))
    key = distance.take(target)
    order = np.argsort(key.astype(np.uint16) if most < 1 << 16 else key, kind="stable")
    source, target, weight = source.take(order), target.take(order), weight.take(order)
    steps = np.r_[0, np.cumsum(np.bincount(key, minlength=most + 1)[1:])]
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    sizes, ends = np.diff(heads, append=len(target)), target.take(heads)
    cuts = np.searchsorted(heads, steps)
    for a, b, i, j in zip(steps[:-1], steps[1:], cuts[:-1], cuts[1:]):
        if a == b:
            continue
        values = sums.take(source[a:b]) + weight[a:b]
        most = np.maximum.reduceat(values, heads[i:j] - a)
        values -= np.repeat(most, sizes[i:j])
        total = np.add.reduceat(np.exp(values, out=values), heads[i:j] - a)
        sums[ends[i:j]] = most + np.log(total)
    return sums


def nodes_of(bounds: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, source node, target node) of each edge."""
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).take(edges.start)
    return string, edges.start + string, edges.stop + string


def backward_sums(bounds: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log sum over all paths from each node to the end of its string."""
    lengths = np.diff(bounds)
    first = bounds[:-1] + np.arange(len(lengths))
    mirror = np.repeat(2 * first + lengths, lengths + 1) - np.arange(int(bounds[-1]) + len(lengths))
    return path_sums(bounds, mirror.take(target), mirror.take(source), weight).take(mirror)
