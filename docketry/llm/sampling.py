"""SentencePiece encoding by sampled segmentations, and decoding.

Segmentations of a text are drawn without replacement in order of their
Gumbel-perturbed log probability (ancestral Gumbel top-k). The pieces and their
merge ranks come from an existing vocabulary; Zipf's law makes weights of the
ranks. The search is A-star over the lattice: with backward sums, every choice of
a next piece has its exact share of the probability of all segmentations, so the
largest perturbed value below any node can be drawn before the node is opened.
The first sample follows the largest value from the root. At each of its steps
the pieces not taken form a set whose own largest value, a Gumbel truncated at
the parent's, is put on the agenda. The set with the largest value is opened
next: it names the step where the next sample leaves the paths so far. The
agenda's largest value after ``samples`` samples is the threshold of the
inclusion scores, log(1 - exp(-exp(log_prob - threshold))).

No piece leaves a run of spaces with its word or its signs (where one does, as
the vocabulary shows, the runs stay together), so the lattice of a text is a chain of small ones; each
distinct one is built once and kept while it fits. All random numbers come from
a hash of the row's key, the sample and the place, so a row's samples do not
depend on its neighbours, and a repeated task draws the same.

Scale: in the row, without a shuffle; rows are worked on in portions of 30,000
units and the lattices kept are bounded, so memory follows the longest text.
The vocabulary is read on the driver and broadcast (2 MB).

Edge cases: null and empty texts have one segmentation, without pieces, and
decode to empty text; a text with fewer segmentations than samples gives what it
has, with inclusion score 0 (certain); U+2581 and characters without a piece are
bytes; rows of equal key and text give equal samples; a null key seeds like any
value; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import lattice

# Bounds of a worker's memory: units worked on at once, and the lattices kept.
PORTION = 30_000
MAX_NODES = 500_000
MAX_EDGES = 2_000_000
SAMPLES = 2
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_streams(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A stream of random numbers for each place of a row."""
    with np.errstate(over="ignore"):
        return mixed(seed + GOLDEN * (place.astype(np.uint64) + np.uint64(1)))


def uniform(stream: np.ndarray, purpose: int, count: np.ndarray | int) -> np.ndarray:
    """Numbers above 0 and below 1, with 31 bits."""
    with np.errstate(over="ignore"):
        number = mixed(stream + GOLDEN * (np.asarray(count, np.uint64) + np.uint64((purpose + 1) << 32)))
    return ((number >> np.uint64(33)).astype(np.float64) + 0.5) / 2.0**31


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel(location) below ``most``; -inf where the location is."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(
            np.isneginf(location), -np.inf, location - np.log(np.exp(location - most) - np.log(u))
        )


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lattices:
    """The lattices of the units met so far, in arrays.

    ``piece``: an id, or -1 less the code point of a character written as bytes.
    A node's edges follow each other, long ones first; ``upto`` is the share of a
    node's edges up to and including this one, 2 for the last.
    """

    def __init__(self, vocabulary: lattice.Vocabulary, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.allocate(MAX_NODES, MAX_EDGES)

    def allocate(self, nodes: int, edges: int) -> None:
        self.unit_ids: dict[str, int] = {}
        self.first = np.zeros(0, np.int64)
        self.met_again = np.zeros(0, bool)  # in a portion after that which built it
        self.n_nodes = self.n_edges = 0
        self.begin = np.zeros(nodes + 1, np.int64)
        self.is_end = np.zeros(nodes, bool)
        self.upto = np.zeros(edges, np.float32)
        self.log_share = np.zeros(edges)
        self.target = np.zeros(edges, np.int32)
        self.piece = np.zeros(edges, np.int32)

    def ids(self, units: list[str]) -> np.ndarray:
        """Number of each unit; builds the lattices of new ones."""
        distinct = dict.fromkeys(units)
        new = [u for u in distinct if u not in self.unit_ids]
        known = len(self.unit_ids)
        if new and not self.add(new):
            self.forget()
            new = [u for u in distinct if u not in self.unit_ids]
            known = len(self.unit_ids)
            if not self.add(new):
                new, known = list(distinct), 0
                self.allocate(MAX_NODES, MAX_EDGES)
                if not self.add(new):
                    size = sum(map(len, new))
                    self.allocate(size + len(new), 17 * size)
                    self.add(new)
        numbers = np.fromiter(map(self.unit_ids.__getitem__, units), np.int64, len(units))
        self.met_again[numbers[numbers < known]] = True
        return numbers

    def forget(self) -> None:
        """Keep the units that were met in several portions, up to half of the room."""
        nodes = np.diff(self.first, append=self.n_nodes)
        edges = np.diff(self.begin[np.r_[self.first, self.n_nodes]])
        kept = np.flatnonzero(self.met_again)
        fits = (2 * np.cumsum(nodes[kept]) <= MAX_NODES) & (2 * np.cumsum(edges[kept]) <= MAX_EDGES)
        kept = kept[fits]
        names = list(self.unit_ids)
        first, nodes, edges = self.first[kept], nodes[kept], edges[kept]
        old_nodes, old_edges = stretches(first, nodes), stretches(self.begin[first], edges)
        sizes, is_end = np.diff(self.begin[: self.n_nodes + 1])[old_nodes], self.is_end[old_nodes]
        found = [x[old_edges] for x in (self.upto, self.log_share, self.target, self.piece)]
        if len(self.is_end) != MAX_NODES:
            self.allocate(MAX_NODES, MAX_EDGES)
        self.first = np.cumsum(nodes) - nodes
        self.n_nodes, self.n_edges = len(old_nodes), len(old_edges)
        self.begin[1 : self.n_nodes + 1] = np.cumsum(sizes)
        self.is_end[: self.n_nodes] = is_end
        found[2] += np.repeat(self.first - first, edges).astype(np.int32)
        for array, values in zip((self.upto, self.log_share, self.target, self.piece), found):
            array[: self.n_edges] = values
        self.unit_ids = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.met_again = np.zeros(len(kept), bool)

    def add(self, units: list[str]) -> bool:
        """False, and nothing is added, if they do not fit."""
        codes, bounds = lattice.code_points(units)
        nodes = len(codes) + len(units)
        if self.n_nodes + nodes > len(self.is_end):
            return False
        codes[codes == lattice.SPACE_CODE] = lattice.LITERAL_SPACE
        codes[codes == ord(" ")] = lattice.SPACE_CODE
        edges = lattice.find_edges(self.vocabulary, codes, bounds)
        n = len(edges.start)
        if self.n_edges + n > len(self.upto):
            return False
        _, source, target = lattice.nodes_of(bounds, edges)
        weight = lattice.edge_weights(self.vocabulary, codes, edges, self.weights)
        after = lattice.backward_sums(bounds, source, target, weight)
        log_share = np.minimum(weight + after.take(target) - after.take(source), 0.0)
        a, b = self.n_nodes, self.n_edges
        heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        sizes = np.diff(np.r_[heads, n])
        sums = np.cumsum(np.exp(log_share))
        upto = sums - np.repeat(np.r_[0.0, sums[heads[1:] - 1]], sizes)
        upto[np.r_[heads[1:], n] - 1] = 2.0
        self.upto[b : b + n] = upto
        self.log_share[b : b + n] = log_share
        self.target[b : b + n] = a + target
        bare = edges.piece == lattice.BYTE
        self.piece[b : b + n] = np.where(bare, -1 - codes[edges.start], edges.piece)
        counts = np.bincount(source, minlength=nodes)
        self.begin[a + 1 : a + nodes + 1] = b + np.cumsum(counts)
        ends = bounds[1:] + np.arange(len(units))
        self.is_end[a : a + nodes] = False
        self.is_end[a + ends] = True
        start = len(self.unit_ids)
        self.unit_ids.update(zip(units, range(start, start + len(units))))
        self.first = np.r_[self.first, a + bounds[:-1] + np.arange(len(units))]
        self.met_again = np.r_[self.met_again, np.zeros(len(units), bool)]
        self.n_nodes, self.n_edges = a + nodes, b + n
        return True

    def walk(self, nodes: np.ndarray, streams: np.ndarray, purpose: int):
        """A drawn path from each node to the end of its unit: edges end to end,
        and the bounds of each path."""
        active = np.flatnonzero(~self.is_end.take(nodes))
        at, step = nodes.take(active), 0
        counts = np.zeros(len(nodes), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            u = uniform(streams.take(active), purpose, step)
            edge = self.begin.take(at)
            further = np.flatnonzero(self.upto.take(edge) <= u)
            while len(further):
                tried = edge.take(further) + 1
                edge[further] = tried
                further = further.take(np.flatnonzero(self.upto.take(tried) <= u.take(further)))
            taken.append((active, edge))
            counts[active] = step + 1
            at = self.target.take(edge)
            going = np.flatnonzero(~self.is_end.take(at))
            active, at, step = active.take(going), at.take(going).astype(np.int64), step + 1
        bounds = np.r_[0, np.cumsum(counts)]
        path = np.zeros(bounds[-1], np.int64)
        for step, (who, edge) in enumerate(taken):
            path[bounds.take(who) + step] = edge
        return path, bounds

    def leave(self, edge: int, passed: list[int], u: float) -> tuple[int, float]:
        """Another edge of the same node, neither this nor one passed before, and
        the share of those that are then left."""
        node = int(np.searchsorted(self.begin[: self.n_nodes + 1], edge, side="right")) - 1
        first, last = int(self.begin[node]), int(self.begin[node + 1])
        share = np.exp(self.log_share[first:last]).tolist()
        for gone in (edge, *passed):
            share[gone - first] = 0.0
        point, chosen = u * sum(share), -1
        for i, s in enumerate(share):
            if s > 0:
                chosen = i
                point -= s
                if point < 0:
                    break
        share[chosen] = 0.0
        return first + chosen, sum(share)


class Round:
    """The sample of one number for many texts, end to end.

    ``beside``: largest perturbed value of the set beside each step. Steps before
    ``own`` belong to the path that this one left and have no set here.
    """

    def __init__(
        self,
        tables: Lattices,
        number: int,
        seeds: np.ndarray,
        path: np.ndarray,
        units: np.ndarray,
        bounds: np.ndarray,
        values: np.ndarray,
        own: np.ndarray,
    ):
        self.path, self.units, self.bounds, self.values = path, units, bounds, values
        sizes = np.diff(bounds)
        share = tables.log_share.take(path)
        sums = np.r_[0.0, np.cumsum(share)]
        self.before = sums[:-1] - np.repeat(sums[bounds[:-1]], sizes)
        self.log_prob = sums[bounds[1:]] - sums[bounds[:-1]]
        with np.errstate(divide="ignore"):
            location = self.before + np.log(-np.expm1(share))
        place = np.arange(len(path)) - np.repeat(bounds[:-1], sizes)
        location[place < np.repeat(own, sizes)] = -np.inf
        u = uniform(row_streams(np.repeat(seeds, sizes), place), 2, number)
        self.beside = truncated_gumbel(location, np.repeat(values, sizes), u)
        self.top = [self.find_top(i) for i in range(len(sizes))]

    def find_top(self, text: int) -> tuple[float, int]:
        a, b = self.bounds[text], self.bounds[text + 1]
        if a == b:
            return -np.inf, 0
        at = a + int(self.beside[a:b].argmax())
        return float(self.beside[at]), at


class Search:
    """The agenda of one text: where the rounds that have a path of it keep it."""

    def __init__(self, seed: np.uint64, nodes: np.ndarray):
        self.seed, self.nodes = seed, nodes
        self.paths: list[tuple[Round, int]] = []
        self.passed: dict[tuple[int, int], list[int]] = {}

    def best(self) -> tuple[float, int]:
        """The agenda's largest value and the path beside which it is."""
        return max(((r.top[i][0], n) for n, (r, i) in enumerate(self.paths)), default=(-np.inf, 0))

    def open(self, tables: Lattices, draws: np.ndarray):
        """Leave a path where the agenda says: (value, steps and units up to and
        with the new edge, the node it leads to); None if there is nothing left."""
        value, number = self.best()
        if value == -np.inf:
            return None
        found, text = self.paths[number]
        at = found.top[text][1]
        passed = self.passed.setdefault((number, at), [])
        edge, left = tables.leave(int(found.path[at]), passed, draws[0])
        passed.append(edge)
        location = found.before[at] + np.log(left) if left > 1e-15 else -np.inf
        found.beside[at] = truncated_gumbel(np.float64(location), np.float64(value), draws[1])
        found.top[text] = found.find_top(text)
        first = found.bounds[text]
        return value, np.r_[found.path[first:at], edge], found.units[first : at + 1], int(tables.target[edge])


def sampled_paths(tables: Lattices, texts: list[list[str]], seeds: np.ndarray, samples: int) -> list[Search]:
    """For each text its search after ``samples`` samples."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.r_[0, np.cumsum(lengths)]
    numbers = tables.ids([u for t in texts for u in t])
    nodes = tables.first[numbers]  # after ids(), which adds to it
    searches = [Search(s, nodes[a:b]) for s, a, b in zip(seeds, bounds[:-1], bounds[1:])]
    places = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    path, steps = tables.walk(nodes, row_streams(np.repeat(seeds, lengths), places), 8)
    roots = -np.log(-np.log(uniform(row_streams(seeds, np.zeros(len(seeds))), 1, 0)))
    units = np.repeat(places, np.diff(steps))
    now = Round(tables, 0, seeds, path, units, steps[bounds], roots, np.zeros(len(texts), np.int64))
    for i, search in enumerate(searches):
        search.paths.append((now, i))
    for number in range(1, samples):
        draws = np.stack([uniform(row_streams(seeds, np.full(len(seeds), number)), p, 0) for p in (3, 4)], 1)
        opened = [(s, o) for s, d in zip(searches, draws) if (o := s.open(tables, d)) is not None]
        if not opened:
            break
        starts = [np.r_[node, s.nodes[u[-1] + 1 :]] for s, (_, _, u, node) in opened]
        firsts = [np.arange(u[-1], len(s.nodes)) for s, (_, _, u, _) in opened]
        own_seeds = np.array([s.seed for s, _ in opened], np.uint64)
        sizes = np.fromiter(map(len, starts), np.int64, len(starts))
        places = np.concatenate(firsts)
        path, steps = tables.walk(
            np.concatenate(starts), row_streams(np.repeat(own_seeds, sizes), places), 8 + number
        )
        units = np.repeat(places, np.diff(steps))
        cuts = steps[np.r_[0, np.cumsum(sizes)]]
        parts, part_units = [], []
        for (_, (_, head, head_units, _)), a, b in zip(opened, cuts[:-1], cuts[1:]):
            parts += [head, path[a:b]]
            part_units += [head_units, units[a:b]]
        heads = np.array([len(o[1]) for _, o in opened])
        now = Round(
            tables,
            number,
            own_seeds,
            np.concatenate(parts),
            np.concatenate(part_units),
            np.r_[0, np.cumsum(heads + np.diff(cuts))],
            np.array([o[0] for _, o in opened]),
            heads,
        )
        for i, (search, _) in enumerate(opened):
            search.paths.append((now, i))
    return searches


def piece_ids(tables: Lattices, path: np.ndarray) -> np.ndarray:
    """The ids along a path."""
    return split_ids(tables, path, np.array([0, len(path)]))[0]


def split_ids(tables: Lattices, path: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The ids along each of the paths laid end to end."""
    ids = tables.piece.take(path)
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        # Each character without a piece gives way to the ids of its bytes.
        kinds, which = np.unique(ids[bare], return_inverse=True)
        spelled = [tables.vocabulary.byte_ids[list(lattice.bytes_of(-1 - int(k)))].astype(np.int32) for k in kinds]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = np.array([len(x) for x in spelled])[which]
        ends = np.r_[0, np.cumsum(sizes)]
        out, by_kind = np.repeat(ids, sizes), np.argsort(which, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(which, minlength=len(kinds)))]
        for data, a, b in zip(spelled, cuts[:-1], cuts[1:]):
            at = ends[bare[by_kind[a:b]]]
            out[at[:, None] + np.arange(len(data))] = data
        ids, bounds = out, ends[bounds]
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def units_of(text: str | None, pattern: re.Pattern, plain: re.Pattern | None = None) -> list[str]:
    """With the space that the vocabulary expects in front of a text. ``plain`` cuts
    texts without an underscore alike, and faster."""
    if not text:
        return []
    return (plain if plain and "_" not in text else pattern).findall(" " + text)


OUTPUT = "sample int, ids array<int>, log_prob double, log_inclusion double"


def encode(
    documents: DataFrame,
    vocabulary_path: str,
    samples: int = SAMPLES,
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, text_crc32, sample, ids, log_prob, log_inclusion), samples from 0."""
    spark = documents.sparkSession
    vocabulary = lattice.load_vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast((vocabulary.parts(), vocabulary.zipf_weights()))

    def sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights = shared.value
        tables = Lattices(lattice.Vocabulary(*parts), weights)
        units = tables.vocabulary.units
        pattern = re.compile(units)
        plain = re.compile(units.replace(lattice.WORD, r"\w").replace(lattice.SIGN, r"[^\w \n]"))
        for batch in batches:
            seeds = batch.column("row_seed").to_numpy().view(np.uint64)
            rows: list[int] = []
            texts: list[list[str]] = []
            waiting = 0
            for row, value in enumerate(batch.column("row_text")):
                rows.append(row)
                texts.append(units_of(value.as_py(), pattern, plain))
                waiting += len(texts[-1])
                if waiting > PORTION or row + 1 == batch.num_rows:
                    yield portion(tables, batch, rows, texts, seeds[rows])
                    rows, texts, waiting = [], [], 0

    def portion(tables, batch, rows, texts, seeds) -> pa.RecordBatch:
        where, number, ids, log_prob, inclusion = [], [], [], [], []
        searches = sampled_paths(tables, texts, seeds, samples)
        rounds = {id(found): found for search in searches for found, _ in search.paths}
        spelled = {key: split_ids(tables, found.path, found.bounds) for key, found in rounds.items()}
        for row, search in zip(rows, searches):
            threshold = search.best()[0]
            for i, (found, text) in enumerate(search.paths):
                own = float(found.log_prob[text])
                where.append(row)
                number.append(i)
                ids.append(spelled[id(found)][text])
                log_prob.append(own)
                inclusion.append(log_inclusion(own, threshold))
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])]
        flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(where, pa.int64())) for c in ("row_key", "text_crc32")),
                pa.array(number, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                pa.array(log_prob, pa.float64()),
                pa.array(inclusion, pa.float64()),
            ],
            names=["row_key", "text_crc32", "sample", "ids", "log_prob", "log_inclusion"],
        )

    rows = documents.select(
        F.col(key).alias("row_key"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("row_seed"),
        F.col(text).alias("row_text"),
    )
    kind = rows.schema["row_key"].dataType.simpleString()
    return rows.mapInArrow(sample_batches, f"row_key {kind}, text_crc32 long, {OUTPUT}").withColumnRenamed(
        "row_key", key
    )


def log_inclusion(log_prob: float, threshold: float) -> float:
    """log of the probability that a segmentation's value exceeds the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = log_prob - threshold
    # exp(x) is its own complement's logarithm while it is small
    return float(x if x < -36 else np.log(-np.expm1(-np.exp(x))))


def piece_bytes(vocabulary_path: str) -> list[bytes]:
    """What each id decodes to."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary_path)
    return [
        bytes([int(lattice.BYTE_PIECE.match(model.id_to_piece(i))[1], 16)])
        if model.is_byte(i)
        else b""
        if model.is_control(i) or model.is_unknown(i)
        else model.id_to_piece(i).replace(lattice.SPACE, " ").encode()
        for i in range(model.get_piece_size())
    ]


def spelled(letters: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of ids end to end, and 0 and the end of each. ``letters``: those of all
    pieces, which have these sizes."""
    starts = np.cumsum(sizes) - sizes
    ends = np.r_[0, np.cumsum(sizes[ids])]
    parts = []
    for a in range(0, len(ids), PORTION):  # a place takes eight times its letter
        now = ids[a : a + PORTION]
        parts.append(letters.take(stretches(starts[now], sizes[now])).tobytes())
    return b"".join(parts), ends


def decode(spark: SparkSession, ids: Column, vocabulary_path: str) -> Column:
    """The text of a list of ids; null where there is none."""
    pieces = piece_bytes(vocabulary_path)
    sizes = np.array([len(x) for x in pieces], np.int64)
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(pieces), np.uint8), sizes))

    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        letters, sizes = shared.value
        known, bounds = lists.is_valid().to_pylist(), lists.offsets.to_numpy().astype(np.int64)
        found = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
        data, ends = spelled(letters, sizes, found)
        cuts = ends[bounds - bounds[0]].tolist()

        def one(a: int, b: int) -> str:
            return data[a:b].removeprefix(b" ").decode("utf-8", "replace")

        texts = [one(a, b) if k else None for k, a, b in zip(known, cuts, cuts[1:])]
        return pa.array(texts, pa.string())

    return decoded(ids)
