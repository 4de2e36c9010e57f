"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling on Spark.

Words are customers of context restaurants, one per word before (that of a first
word is the end token), which share one parent restaurant of words; that orders
from a base that spells words byte by byte. The spelling is a hierarchy of its own: the restaurant of the
last n bytes orders from that of the last n - 1, so contexts with the same end
share a parent, down to a uniform base over bytes. Everywhere the probability of
a dish is (c - d t + (s + d T) base) / (s + C), with c of C customers at t of T
tables. A word that was never learnt has the probability of its own spelling,
so that a text's score is one of a distribution over all texts. Spellings are
kept as logarithms: that of a word of some thousand bytes is no float.

State lies in tables, one row per dish and context. A sweep takes the levels
from the longest context up: the customers of every dish leave and are seated
again one by one in a Chinese restaurant, joining a table or opening one in
proportion to the parent's current probability; tables opened are the customers
of the parent. Then probabilities are computed from the root down. Dishes of a
level are seated side by side given the other dishes' tables of the last sweep.
Pairs lie in the shard of their word, those of a very frequent word in several;
the tables of a context are summed over all shards once in a sweep. Long queues of one dish are seated in groups of a
sixteenth of those already seated, whose number of new tables is drawn at once, as a
binomial number.
Spelling restaurants serve each distinct word once. Discounts are estimated
from the counts of ones and twos. Predictive probabilities are averaged over
``SAMPLES`` states.

Every random number is a hash of the dish, level and sweep: a task that is run
again on a lost executor draws the same. A null or empty text is its end token
alone. Repeated rows count as often as they occur; a null id is learnt from.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import bound_batches, drop_written, raw, written

ORDER = 4  # bytes of context in the longest spelling restaurant
SAMPLES = 2
BURN_IN = 1
STRENGTH = 1.0
END = b"\n"
PAD = b" "
WORD_SWEEPS = 2
BUNDLE_BYTES = 12 << 20
SHARDS_PER_SPLIT = 6
SHARDS_PER_OWNER = 4
SPLIT = 1 << 17  # occurrences of a word beyond which its pairs lie in several shards
GOLDEN = 0x9E3779B97F4A7C15
CODEC = "zstd"
SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, byte plane by byte plane, compressed together."""
    shapes, planes = [], []
    for x in columns:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        shapes.append((width, len(x)))
        planes.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return pickle.dumps((shapes, pa.compress(b"".join(planes), CODEC, asbytes=True)))


def _unpacked(data: bytes) -> list[np.ndarray]:
    shapes, body = pickle.loads(data)
    planes = np.frombuffer(pa.decompress(body, sum(w * n for w, n in shapes), CODEC, asbytes=True), np.uint8)
    columns, at = [], 0
    for width, n in shapes:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = planes[at : at + width * n].reshape(width, n).T
        columns.append(out.view("<i8").ravel())
        at += width * n
    return columns


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers from 0 on, sorted, and the place of each value among them.

    A value and its position are sorted as one number where they fit in one, which
    is several times as fast as sorting positions by value.
    """
    bits = len(values).bit_length()
    if not len(values) or int(values.max()) >> (63 - bits):
        return np.unique(values, return_inverse=True)
    both = np.sort((values << bits) | np.arange(len(values)))
    at = both & ((1 << bits) - 1)
    both >>= bits
    first = np.append(True, both[1:] != both[:-1])
    place = np.empty(len(values), np.int64)
    place[at] = np.cumsum(first) - 1
    return both[first], place


def _grouped(group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their groups, and where each group begins."""
    order = np.argsort(group.astype(np.min_scalar_type(groups)), kind="stable")  # short numbers are sorted by counting
    return order, np.append(0, np.cumsum(np.bincount(group, minlength=groups)))


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of the key and a salt."""
    x = key.astype(np.uint64)
    x += np.uint64((salt * GOLDEN) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return (x.astype(float) + 0.5) / 2**53


def _binomial(n: np.ndarray, p: np.ndarray, draw: np.ndarray, other: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How many of n events of probability p happen: by inversion where few do, else by the normal approximation.

    ``other`` gives a second draw for the places where that is needed.
    """
    p = np.minimum(p, 1 - 1e-12)
    mean = n * p
    found = np.zeros(len(n))
    many = np.flatnonzero(mean >= 8)
    if len(many):
        noise = np.sqrt(-2 * np.log(draw[many])) * np.cos(2 * np.pi * other(many))
        found[many] = np.clip(np.round(mean[many] + noise * np.sqrt(mean[many] * (1 - p[many]))), 0, n[many])
    few = np.flatnonzero(mean < 8)
    n, p, draw = n[few], p[few], draw[few]
    chance = (1 - p) ** n
    below, k = chance, 0
    while True:
        more = np.flatnonzero((draw > below) & (k < n))
        if not len(more):
            return found
        few, n, p, draw, chance, below = (x[more] for x in (few, n, p, draw, chance, below))
        found[few] += 1
        chance = chance * (n - k) / (k + 1) * p / (1 - p)
        below, k = below + chance, k + 1


def seat(key: np.ndarray, customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, salt: int | np.ndarray) -> np.ndarray:
    """Tables of each dish after all its customers have been seated anew.

    ``base`` is the parent's probability of the dish, ``others`` the tables of all
    other dishes of the restaurant. ``salt`` is one for all dishes or one of each.
    Longest queues come first, so that those not yet at their end are a slice.
    """
    tables = np.minimum(customers, 1).astype(float)
    rows = np.flatnonzero(customers > 1)
    rows = rows[np.argsort(-customers[rows])]
    all_n, all_t, all_base, all_others = customers[rows], tables[rows], base[rows], others[rows]
    all_keys = key[rows].astype(np.uint64) + np.broadcast_to(np.asarray(salt).astype(np.uint64), len(key))[rows] * np.uint64(4096 * GOLDEN & (2**64 - 1))
    ends = -all_n
    left, seated, step = len(rows), 1, 1
    while left:
        n, t, keys = all_n[:left], all_t[:left], all_keys[:left]
        fresh = (STRENGTH + discount * (all_others[:left] + t)) * all_base[:left]
        draw = _uniform(keys, 2 * step)
        if seated < 32:
            t += draw < fresh / (fresh + seated - discount * t)
        else:
            group = np.minimum(max(1, seated // 16), n - seated)
            share = fresh / (fresh + seated + (group - 1) / 2 - discount * t)  # that of the group's middle
            t += _binomial(group, share, draw, lambda at, keys=keys, step=step: _uniform(keys[at], 2 * step + 1))
        seated += max(1, seated // 16)
        step += 1
        left = int(np.searchsorted(ends, -seated))
    tables[rows] = all_t
    return tables


def _discount(df: DataFrame, count: Column) -> float:
    one, two = df.agg(F.count(F.when(count == 1, 1)), F.count(F.when(count == 2, 1))).first()
    return _estimate(one, two)


def _seated(df: DataFrame, discount: float, salt: int) -> DataFrame:
    """(key, c, t) from (key, c, base, others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c, base, others = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            t = seat(key, c, base, others.astype(float), discount, salt)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t.astype(np.int64))], ["key", "c", "t"])

    return df.select("key", "c", "base", "others").mapInArrow(run, "key long, c long, t long")


def _shorter(level: int) -> Column:
    """Key of the same byte after a context that is one byte shorter."""
    return F.col("key").bitwiseAND(F.lit((1 << (8 * level)) - 1))


def _with_base(seats: DataFrame, parent: DataFrame | None, level: int, discount: float) -> DataFrame:
    """(key, c, t, base, others, p): the parent's probability, the other tables, and the predictive probability."""
    context = F.shiftright("key", 8)
    totals = seats.groupBy(context.alias("context")).agg(F.sum("c").alias("all_c"), F.sum("t").alias("all_t"))
    rows = seats.withColumn("context", context).join(totals, "context")
    if parent is None:
        rows = rows.withColumn("base", F.lit(1.0 / 256))
    else:
        rows = rows.withColumn("up", _shorter(level)).join(parent.select(F.col("key").alias("up"), F.col("p").alias("base")), "up")
    p = (F.col("c") - discount * F.col("t") + (STRENGTH + discount * F.col("all_t")) * F.col("base")) / (STRENGTH + F.col("all_c"))
    return rows.select("key", "c", "t", "base", (F.col("all_t") - F.col("t")).alias("others"), p.alias("p"))


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of every word and its end, each with ORDER bytes of context, and their number per word."""
    joined = np.frombuffer(b"".join([PAD * ORDER + w + PAD for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    key = np.zeros(max(0, len(joined) - ORDER), np.int64)
    for k in range(ORDER + 1):
        key = (key << 8) | joined[k : len(joined) - ORDER + k]
    # positions of the windows that end inside a word or at its end
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    return key[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


def spelling_counts(vocabulary: DataFrame) -> DataFrame:
    """(key, c) over all words (word, c): in how many learnt words a byte follows its context; zero is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = spelling_keys(batch.column(0).to_pylist())
            learnt = np.repeat(batch.column(1).to_numpy() > 0, sizes)
            found, place = _distinct(keys)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(place, learnt, len(found)).astype(np.int64))], ["key", "c"])

    return vocabulary.select("word", "c").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def spelling_model(counts: DataFrame) -> DataFrame:
    """(key, p0, p1, ...): the predictive probabilities of each sample after ORDER bytes of context."""
    levels = range(ORDER, -1, -1)
    seats: dict[int, DataFrame] = {ORDER: written(counts.withColumn("t", F.least("c", F.lit(1))), "seats")}
    for level in levels[1:]:  # one table per dish to begin with
        served = seats[level + 1].groupBy(_shorter(level + 1).alias("key")).agg(F.sum("t").alias("c"))
        seats[level] = written(served.withColumn("t", F.least("c", F.lit(1).cast("long"))), "seats")
    discounts = {level: _discount(seats[level], F.col("c")) for level in levels}

    def downwards() -> dict[int, DataFrame]:
        state: dict[int, DataFrame] = {}
        for level in range(ORDER + 1):
            state[level] = written(_with_base(seats[level], state.get(level - 1), level, discounts[level]), "state")
        drop_written(*seats.values())
        return state

    state = downwards()
    samples = []
    for sweep in range(BURN_IN + SAMPLES):
        for level in levels:
            old = state[level]
            if level < ORDER:
                served = seats[level + 1].groupBy(_shorter(level + 1).alias("key")).agg(F.sum("t").alias("c"))
                old = old.drop("c").join(served, "key")
            seats[level] = written(_seated(old, discounts[level], sweep * (ORDER + 1) + level), "seats")
        drop_written(*[df for df in state.values() if df not in samples])
        state = downwards()
        if sweep >= BURN_IN:
            samples.append(state[ORDER])
    joined, *others = [sample.select("key", F.col("p").alias(f"p{i}")) for i, sample in enumerate(samples)]
    for sample in others:
        joined = joined.join(sample, "key")
    model = written(joined, "spelling")
    drop_written(*state.values(), *samples)
    return model


VOCABULARY = "shard long, place long, word binary, hash long, c long, n long"
BASES = "shard long, place long, hashes binary, base binary"


def spelled(vocabulary: DataFrame, model: DataFrame, often: int) -> DataFrame:
    """BASES: hashes of words and the logarithms of their spellings' probabilities in each sample, in the order of ``place``.

    A row per shard, of null place, and one of its own for each word that occurs
    more than ``often`` times. A shard of words asks for each of its keys once.
    """
    by = vocabulary.groupBy("shard")

    def ask(table: pa.Table) -> pa.Table:
        keys = np.unique(spelling_keys(table.column("word").to_pylist())[0])
        return pa.table({"shard": np.full(len(keys), table.column("shard")[0].as_py()), "key": keys})

    def answer(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], ["shard", "place", "hashes", "base"])
        table = table.sort_by("place")
        keys, sizes = spelling_keys(table.column("word").to_pylist())
        known = answers.column("key").to_numpy()
        order = np.argsort(known)
        p = np.stack([answers.column(f"p{i}").to_numpy() for i in range(SAMPLES)], axis=1)
        each = np.log(p)[order][np.searchsorted(known[order], keys)]
        base, hashes = np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0), table.column("hash").to_numpy()
        some = np.flatnonzero(table.column("n").to_numpy() > often).tolist()
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()] * (1 + len(some)), pa.int64()),
            "place": pa.array([None, *some], pa.int64()),
            "hashes": pa.array([hashes.tobytes(), *(hashes[i].tobytes() for i in some)], pa.binary()),
            "base": pa.array([base.tobytes(), *(base[i].tobytes() for i in some)], pa.binary()),
        })

    asked = by.applyInArrow(ask, "shard long, key long").join(model, "key")
    return by.cogroup(asked.groupBy("shard")).applyInArrow(answer, BASES)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of arrays without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


WORDS = "shard long, word binary, c long, contexts array<long>, counts array<long>"
STATE = "shard long, owner long, payload binary, stats array<double>"
SEATED, SHARED = -1, -2  # owners of rows that hold a shard's seats, and its part of a word that lies in several shards
STATS = 6


class _Seats:
    """The pairs of one shard, by word: customers and tables of every word after its contexts, and the words in the parent.

    Words are known by their hash, and by their place among the words that several shards share, else -1.
    """

    def __init__(self, key, shared, base, sizes, contexts, counts):
        self.key, self.shared, self.base, self.sizes, self.contexts, self.counts = key, shared, base, sizes, contexts, counts
        self.tables = np.repeat(np.minimum(counts, 1)[:, None], SAMPLES, axis=1)
        opened = np.bincount(self.of, counts > 0, len(key)).astype(np.int64)
        self.up_c = np.repeat(opened[:, None], SAMPLES, axis=1)
        self.up_t = np.minimum(self.up_c, 1)

    @cached_property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.key)), self.sizes)

    @cached_property
    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts, and for each pair the place of its own."""
        return _distinct(self.contexts)

    def pack(self) -> bytes:
        numbers = [self.shared + 1, self.sizes, self.contexts, self.counts, *(x[:, s] for x in (self.tables, self.up_c, self.up_t) for s in range(SAMPLES))]
        return pickle.dumps([self.key.tobytes(), self.base.tobytes(), _packed(*numbers)])

    @classmethod
    def unpack(cls, payload: bytes) -> _Seats:
        key, base, numbers = pickle.loads(payload)
        own, numbers = cls.__new__(cls), _unpacked(numbers)
        own.key, own.base = np.frombuffer(key, np.uint64), np.frombuffer(base).reshape(-1, SAMPLES)
        own.shared, own.sizes, own.contexts, own.counts = numbers[0] - 1, *numbers[1:4]
        own.tables, own.up_c, own.up_t = (np.stack(numbers[i : i + SAMPLES], axis=1) for i in range(4, 4 + 3 * SAMPLES, SAMPLES))
        return own

    def rows(self, shard: int, owners: int, stats: list[float], shared: dict[int, list[float]]) -> pa.Table:
        """One row of the seats, one per word shared with other shards, and one per owner of contexts that asks for their totals."""
        asked, place = self.asked
        sums = [np.bincount(place, x, len(asked)).astype(np.int64) for x in (self.counts, *self.tables.T)]
        order, edges = _grouped(asked % owners, owners)
        some = [o for o in range(owners) if edges[o] < edges[o + 1]]
        parts = [order[edges[o] : edges[o + 1]] for o in some]
        messages = [_packed(np.diff(asked[p], prepend=0), *(x[p] for x in sums)) for p in parts]
        numbers = [stats, *shared.values(), *[[]] * len(some)]
        return pa.table({
            "shard": pa.array([shard, *shared, *[shard] * len(some)], pa.int64()),
            "owner": pa.array([SEATED, *[SHARED] * len(shared), *some], pa.int64()),
            "payload": pa.array([self.pack(), *[None] * len(shared), *messages], pa.binary()),
            "stats": pa.array([x + [0.0] * (STATS - len(x)) for x in numbers], pa.list_(pa.float64())),
        })

    def totals(self, replies: pa.Table, owners: int) -> list[np.ndarray]:
        """Customers of every pair's context, and its tables in each sample, from the owners' replies."""
        asked, place = self.asked
        order = _grouped(asked % owners, owners)[0]
        numbers = zip(replies.column("owner").to_pylist(), replies.column("payload").to_pylist(), strict=True)
        found = []
        for column in zip(*[_unpacked(payload) for _, payload in sorted(numbers)], strict=True):
            total = np.empty(len(asked), np.int64)
            total[order] = np.concatenate(column)
            found.append(total[place])
        return found


def _context_totals(state: DataFrame) -> DataFrame:
    """(shard, owner, payload): customers and tables of the contexts a shard asked about, summed over all shards."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_unpacked(payload) for payload in table.column("payload").to_pylist()]
        ids = [np.cumsum(x[0]) for x in asked]
        known, place = _distinct(np.concatenate(ids))
        sums = [np.bincount(place, np.concatenate(x), len(known)).astype(np.int64) for x in list(zip(*asked, strict=True))[1:]]
        ends = np.cumsum([len(x) for x in ids])[:-1]
        replies = [_packed(*(x[p] for x in sums)) for p in np.split(place, ends)]
        return pa.table([table.column("shard"), table.column("owner"), pa.array(replies, pa.binary())], names=["shard", "owner", "payload"])

    return state.where("owner >= 0").select("owner", "shard", "payload").groupBy("owner").applyInArrow(run, "shard long, owner long, payload binary")


def _stats(state: DataFrame, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all shards, and those of each word that several shards share."""
    rows = state.where("owner < 0").groupBy(F.when(F.col("owner") == SHARED, F.col("shard")).alias("word")).agg(*[F.sum(F.col("stats")[i]) for i in range(STATS)]).collect()
    own, each = np.zeros(STATS), np.zeros((shared, STATS))
    for word, *sums in rows:
        if word is None:
            own = np.array(sums)
        else:
            each[word] = sums
    return own, each


def _estimate(one: float, two: float) -> float:
    """Discount from how many counts are one and two."""
    return float(min(0.95, max(0.05, (one + 0.5) / (one + 2 * two + 1))))


def log_probability(counts, tables, c, t, log_base, customers, all_tables, up_c, up_t, d_pair: float, d_up: float) -> np.ndarray:
    """log10 of the predictive probability of words after contexts, averaged over the samples.

    One row per pair: ``counts`` in the context and ``tables`` there per sample, ``c`` and ``t``
    of the word in the parent, logarithms of its spelling, all customers and tables of the context,
    and all of the parent per sample.
    """
    leave = (STRENGTH + d_pair * all_tables) / (STRENGTH + customers)[:, None]
    leave_up = (STRENGTH + d_up * up_t) / (STRENGTH + up_c)
    seen = (counts[:, None] - d_pair * tables) / (STRENGTH + customers)[:, None] + leave * (c - d_up * t) / (STRENGTH + up_c)
    with np.errstate(divide="ignore"):
        each = np.logaddexp(np.log(np.maximum(seen, 0.0)), np.log(leave * leave_up) + log_base)
    return (np.logaddexp.reduce(each, axis=1) - np.log(each.shape[1])) / np.log(10)


SCORES = ["base_score", "score", "known_base_score", "known_score"]


def _seats_of(table: pa.Table) -> _Seats:
    sizes, contexts = _lists(table.column("contexts").combine_chunks())
    counts, base = (_lists(table.column(name).combine_chunks())[1] for name in ("counts", "base"))
    return _Seats(_word_hash(table.column("word").to_pylist()), np.full(len(sizes), -1), base.reshape(-1, SAMPLES), sizes, contexts, counts)


def first_rows(own: _Seats, shard: int, owners: int) -> pa.Table:
    """Rows of STATE before the first sweep."""
    opened = own.up_c[:, 0].copy()
    at = np.flatnonzero(own.shared >= 0)
    parts = {j: [float(n)] for j, n in zip(own.shared[at].tolist(), opened[at].tolist(), strict=True)}
    opened[at] = 0
    few = [float((x == k).sum()) for x in (own.counts, opened) for k in (1, 2)]
    return own.rows(shard, owners, [*few, float(opened.sum()), float((opened > 0).sum())], parts)


def word_model(words: DataFrame, split: Sequence[tuple[int, list[float]]] = (), owners: int = 1, arrays: bool = True) -> DataFrame:
    """(shard, contexts, logp), one row per shard and by word, from a written table that is removed.

    That is (shard, word, c, contexts, counts, base), or the rows of STATE that
    ``first_rows`` makes of these. ``split`` holds hash and base of each word whose pairs
    lie in several shards. logp holds, for each word and context, log10 of the
    word's predictive probability, averaged over the samples. Without ``arrays`` the
    rows are (shard, logp) and logp the bytes of its numbers.
    """
    shared_key = np.array([key for key, _ in split], np.uint64)
    shared_base = np.exp(np.array([base for _, base in split], float).reshape(len(split), SAMPLES))
    if "payload" not in words.columns:
        rows = words
        words = written(rows.groupBy("shard").applyInArrow(lambda t: first_rows(_seats_of(t), t.column("shard")[0].as_py(), owners), STATE), "seats")
        drop_written(rows)

    state = words
    own, parts = _stats(state, len(split))
    opened = parts[:, 0]
    d_pair, d_up = _estimate(*own[:2]), _estimate(own[2] + (opened == 1).sum(), own[3] + (opened == 2).sum())
    shared_c = np.repeat(opened[:, None], SAMPLES, axis=1)
    shared_t = np.minimum(shared_c, 1)
    up_c, up_t = (np.full(SAMPLES, own[i]) + x.sum(axis=0) for i, x in ((4, shared_c), (5, shared_t)))

    def parents(seats: _Seats, shared_c: np.ndarray, shared_t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of the words in the parent, and which words are shared."""
        c, t = seats.up_c.astype(float), seats.up_t.astype(float)
        at = np.flatnonzero(seats.shared >= 0)
        c[at], t[at] = shared_c[seats.shared[at]], shared_t[seats.shared[at]]
        return c, t, at

    for sweep in range(WORD_SWEEPS):

        def run(state: pa.Table, replies: pa.Table) -> pa.Table:
            own, shard = _Seats.unpack(state.column("payload")[0].as_py()), state.column("shard")[0].as_py()
            totals, of, key = own.totals(replies, owners), own.of, own.key
            pair_key = key[of] + (own.contexts.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
            old_c, old_t, at = parents(own, shared_c, shared_t)
            base = np.exp(own.base)
            above = (old_c - d_up * old_t + (STRENGTH + d_up * up_t) * base) / (STRENGTH + up_c)
            salts = 1000 + 2 * (sweep * SAMPLES + np.arange(SAMPLES))

            def seated(key: np.ndarray, customers: list[np.ndarray], base: list[np.ndarray], tables: Sequence, discount: float, salts: np.ndarray) -> np.ndarray:
                """Tables of every dish in each sample, all samples seated at once."""
                others = [np.maximum(0.0, t - np.minimum(c, 1)) for t, c in zip(tables, customers, strict=True)]
                found = seat(np.tile(key, SAMPLES), np.concatenate(customers), np.concatenate(base), np.concatenate(others), discount, np.repeat(salts, len(key)))
                return found.reshape(SAMPLES, -1).T

            own.tables = seated(pair_key, [own.counts] * SAMPLES, [above[of, s] for s in range(SAMPLES)], totals[1:], d_pair, salts)
            own.up_c = np.stack([np.bincount(of, t, len(key)) for t in own.tables.T], axis=1).astype(np.int64)
            own.up_t = seated(key, list(own.up_c.T), list(base.T), up_t, d_up, salts + 1)
            parts = dict(zip(own.shared[at].tolist(), own.up_c[at].astype(float).tolist(), strict=True))
            own.up_c[at] = own.up_t[at] = 0
            return own.rows(shard, owners, [*own.up_c.sum(axis=0).astype(float).tolist(), *own.up_t.sum(axis=0).astype(float).tolist()], parts)

        before = state
        state = written(before.where(F.col("owner") == SEATED).groupBy("shard").cogroup(_context_totals(before).groupBy("shard")).applyInArrow(run, STATE), "seats")
        drop_written(before)
        own, parts = _stats(state, len(split))
        shared_c = parts[:, :SAMPLES]
        shared_t = np.zeros_like(shared_c)
        for s in range(SAMPLES):
            others = np.maximum(0.0, up_t[s] - np.minimum(shared_c[:, s], 1))
            shared_t[:, s] = seat(shared_key, shared_c[:, s], shared_base[:, s], others, d_up, 1001 + 2 * (sweep * SAMPLES + s))
        up_c, up_t = own[:SAMPLES] + shared_c.sum(axis=0), own[SAMPLES : 2 * SAMPLES] + shared_t.sum(axis=0)

    def predict(state: pa.Table, replies: pa.Table) -> pa.Table:
        own, shard = _Seats.unpack(state.column("payload")[0].as_py()), state.column("shard")[0].as_py()
        totals, of = own.totals(replies, owners), own.of
        c, t, _ = parents(own, shared_c, shared_t)
        logp = log_probability(own.counts, own.tables, c[of], t[of], own.base[of], totals[0], np.stack(totals[1:], axis=1), up_c, up_t, d_pair, d_up).astype("<f4")
        if not arrays:
            return pa.table({"shard": pa.array([shard], pa.int64()), "logp": pa.array([logp.tobytes()], pa.binary())})
        return pa.table({"shard": pa.array([shard], pa.int64()), "contexts": pa.array([own.contexts]), "logp": pa.array([logp])})

    seats = state.where(F.col("owner") == SEATED).groupBy("shard")
    return seats.cogroup(_context_totals(state).groupBy("shard")).applyInArrow(predict, "shard long, contexts array<long>, logp array<float>" if arrays else "shard long, logp binary")


def _binaries(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Strings of bytes of the given sizes that lie one after the other in ``data``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes, dtype=np.int64))), pa.py_buffer(data)])


def _bytes_of(words: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Where the words of an array without nulls begin, and their bytes."""
    _, edges, data = words.buffers()
    return np.frombuffer(edges, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64), memoryview(data or b"")


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """Tokens of every text as places among the distinct words, how many each text has, and those words.

    The words of all texts are found and numbered at once, without an object per token.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = np.zeros(len(data) + 1, bool)  # shifted by one, so that a change is where a word begins or ends
    inside[1:] = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # each text ends in a space, so every word has an end
    starts = edges[::2]
    found = _binaries(data[inside[1:]], edges[1::2] - starts).dictionary_encode()
    ends = np.searchsorted(starts, np.cumsum(sizes + 1))
    tokens = np.insert(found.indices.to_numpy().astype(np.int64), ends, len(found.dictionary))
    return tokens, np.diff(ends, prepend=0) + 1, pa.concat_arrays([found.dictionary, pa.array([END], pa.large_binary())])


TEXTS, DOCUMENT = -2, -1  # rows of a bundle that belong to no shard: the tokens of all its documents, and a document


class _Bundle:
    """Documents of one task: their tokens as places among the distinct words, ordered by hash."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, key, learns: bool, text: bytes) -> None:
        self.rows.append((key, learns, text))
        self.size += len(text) + 1

    def emit(self, number: int, shards: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row per document, one with the tokens of all, and one per shard with the words asked about and their counts."""
        keys, learns, texts = zip(*self.rows, strict=True)
        tokens, sizes, distinct = tokens_of(list(texts))
        words = distinct.to_pylist()
        key = _word_hash(words)
        order = _by_hash(words, key)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        counts, every = np.bincount(tokens, np.repeat(learns, sizes), len(words)).astype(np.int64), np.bincount(tokens, minlength=len(words))
        starts, data = _bytes_of(distinct.take(pa.array(order)))
        edges = np.searchsorted(_range(key[order], shards), np.arange(shards + 1))
        some = [s for s in range(shards) if edges[s] < edges[s + 1]]
        asked = [slice(edges[s], edges[s + 1]) for s in some]
        named = [pa.compress(data[starts[a.start] : starts[a.stop]], CODEC, asbytes=True) for a in asked]
        n, m = len(keys), len(some)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * (1 + n + m), pa.int64()),
            pa.array([TEXTS, *[DOCUMENT] * n, *some], pa.int64()),
            pa.array([_packed(sizes, tokens), *[None] * n, *named], pa.binary()),
            pa.array([None] * (1 + n) + [_packed(np.diff(starts[a.start : a.stop + 1]), counts[a], every[a]) for a in asked], pa.binary()),
            pa.array([None, *range(n), *[None] * m], pa.int64()),
            pa.array([None, *keys, *[None] * m], id_type),
            pa.array([None, *(not x for x in learns), *[None] * m], pa.bool_()),
        ], ["bundle", "shard", "payload", "counts", "place", "id", "held_out"])


def _by_hash(words: list[bytes], key: np.ndarray) -> np.ndarray:
    """Order of words by hash, words of one hash by their bytes."""
    order = np.argsort(key, kind="stable")
    if (np.diff(key[order]) == 0).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (key[i], words[i])), np.int64)
    return order


def _range(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash: shards are ranges of hashes."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class _Numbers:
    """Where words numbered in the order of their hashes lie, and in how many shards the pairs of very frequent ones do."""

    def __init__(self, sizes: list[int], split: list[tuple[int, int]]):
        self.starts = np.append(0, np.cumsum(sizes))
        self.total, self.shards = int(self.starts[-1]), len(sizes)
        self.split, self.pieces = (np.array([x[i] for x in sorted(split)], np.int64) for i in (0, 1))

    def shared(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are split, and their places among those."""
        at = np.searchsorted(self.split, word)
        found = np.flatnonzero(self.split[np.minimum(at, len(self.split) - 1)] == word) if len(self.split) else np.zeros(0, np.int64)
        return found, at[found]

    def shard(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.starts, word, "right") - 1
        at, which = self.shared(word)
        mixed = (context[at].astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(33)).astype(np.int64)
        shard[at] = (shard[at] + mixed % self.pieces[which]) % self.shards
        return shard

    def keys(self, shard: int, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """One number per pair of a shard: its own words by place, then those that are split."""
        slot = word - self.starts[shard]
        at, which = self.shared(word)
        slot[at] = self.starts[shard + 1] - self.starts[shard] + which
        return slot * self.total + context


def _pairs(docs: pa.Table, replies: pa.Table, numbers: _Numbers) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bundle's documents, their sizes and tokens, numbers and counts of its words, its distinct pairs, and for each token its pair."""
    replies = sorted(zip(replies.column("shard").to_pylist(), replies.column("payload").to_pylist(), strict=True))
    found = [(s, *_unpacked(payload)) for s, payload in replies]
    ids, c = np.concatenate([numbers.starts[s] + places for s, places, _ in found]), np.concatenate([n for *_, n in found])
    is_document = pc.equal(docs.column("shard"), DOCUMENT)
    sizes, tokens = _unpacked(docs.filter(pc.invert(is_document)).column("payload")[0].as_py())
    pairs, place = _distinct(tokens * len(ids) + np.roll(tokens, 1))  # a document's first word follows an end
    return docs.filter(is_document).sort_by("place"), sizes, tokens, ids, c, pairs, place


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", split_at: int = SPLIT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base_score, known_score) for every row of ``docs``.

    The model learns from the rows for which ``learns`` holds. base_score is that
    of add-one unigram counts, both as log10 of the probability of the whole text.
    The base gives every word that was never learnt the same share, the model that
    of its spelling, so they compare by the sums over learnt tokens alone.

    Texts are read once: a task keeps its documents as places among the distinct
    words of a bundle. Words are sent to the shard of their hash, counted and
    numbered there; then the distinct pairs of a bundle, as numbers of context and
    word, are sent to the shard of their word, counted and scored, and the scores
    come back bundle by bundle. The pairs of a word that occurs more than
    ``split_at`` times are dealt to several shards by context.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text"), F.coalesce(learns, F.lit(True)).alias("learns"))
    shards = SHARDS_PER_SPLIT * max(1, docs.rdd.getNumPartitions()) + 1
    owners = shards // SHARDS_PER_OWNER + 1
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bundle, id_type = TaskContext.get().partitionId() << 32, _Bundle(), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text, learn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                bundle.add(key, learn, text)
                if bundle.size >= BUNDLE_BYTES:
                    yield bundle.emit(number, shards, id_type)
                    number, bundle = number + 1, _Bundle()
        if bundle.rows:
            yield bundle.emit(number, shards, id_type)

    rows = written(own.mapInArrow(read, f"bundle long, shard long, payload binary, counts binary, place long, id {kind}, held_out boolean"), "bundles")
    asked = rows.where("shard >= 0").select("bundle", "shard", "payload", "counts").groupBy("shard")

    def count(table: pa.Table) -> pa.Table:
        """A row per word of the shard, and one per bundle with the places and counts of the words it asks about."""
        numbers = [_unpacked(x) for x in table.column("counts").to_pylist()]
        sizes, counts, every = map(np.concatenate, zip(*numbers, strict=True))
        data = b"".join(pa.decompress(x, int(n.sum()), CODEC, asbytes=True) for x, (n, *_) in zip(table.column("payload").to_pylist(), numbers, strict=True))
        known = _binaries(data, sizes).dictionary_encode()
        words = known.dictionary.to_pylist()
        key = _word_hash(words)
        order = _by_hash(words, key)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = rank[known.indices.to_numpy()]
        c, n = (np.bincount(places, x, len(words)).astype(np.int64) for x in (counts, every))
        replies = [_packed(p, c[p]) for p in np.split(places, np.cumsum([len(x) for x, *_ in numbers])[:-1])]
        w, b = len(words), len(numbers)
        of_words = [np.full(w, table.column("shard")[0].as_py()), np.arange(w), known.dictionary.take(pa.array(order)).cast(pa.binary()), key[order].view(np.int64), c, n]
        shard, *others = ((x if isinstance(x, pa.Array) else pa.array(x)) for x in of_words)
        return pa.Table.from_arrays([
            pa.concat_arrays([shard, pa.array([table.column("shard")[0].as_py()] * b, pa.int64())]), *(pa.concat_arrays([x, pa.nulls(b, x.type)]) for x in others),
            pa.concat_arrays([pa.nulls(w, pa.int64()), table.column("bundle").combine_chunks()]), pa.array([*[None] * w, *replies], pa.binary()),
        ], ["shard", "place", "word", "hash", "c", "n", "bundle", "payload"])

    found = written(asked.applyInArrow(count, VOCABULARY + ", bundle long, payload binary"), "vocabulary")
    vocabulary, replies = found.where("bundle IS NULL").select("shard", "place", "word", "hash", "c", "n"), found.where("bundle IS NOT NULL").select("bundle", "shard", "payload")
    sizes, total, distinct = [0] * shards, 0, 0
    for shard, n, c, learnt in vocabulary.groupBy("shard").agg(F.count("*"), F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).collect():
        sizes[shard], total, distinct = n, total + c, distinct + learnt
    starts = np.append(0, np.cumsum(sizes))
    often = vocabulary.where(F.col("n") > split_at).select("shard", "place", "n").collect()
    numbers = _Numbers(sizes, [(int(starts[r.shard]) + r.place, min(shards, r.n // split_at + 1)) for r in often])
    kept = rows.where("shard < 0").select("bundle", "shard", "payload", "place", "id", "held_out").groupBy("bundle")

    def ask(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, sizes, _, ids, _, pairs, place = _pairs(docs, replies, numbers)
        learnt = np.repeat(~docs.column("held_out").to_numpy(), sizes)
        n = np.bincount(place, learnt, len(pairs)).astype(np.int64)
        word, context = ids[pairs // len(ids)], ids[pairs % len(ids)]
        shard = numbers.shard(word, context)
        order, edges = _grouped(shard, shards)
        some = [s for s in range(shards) if edges[s] < edges[s + 1]]
        parts = [order[edges[s] : edges[s + 1]] for s in some]
        return pa.table({
            "bundle": pa.array([docs.column("bundle")[0].as_py()] * len(some), pa.int64()), "shard": pa.array(some, pa.int64()),
            "payload": pa.array([_packed(np.diff(word[p], prepend=0), context[p]) for p in parts], pa.binary()),
            "counts": pa.array([_packed(n[p]) for p in parts], pa.binary()),
        })

    requests = written(kept.cogroup(replies.groupBy("bundle")).applyInArrow(ask, "bundle long, shard long, payload binary, counts binary"), "pairs")
    model = spelling_model(spelling_counts(vocabulary))
    bases = written(spelled(vocabulary, model, split_at), "spelled")
    drop_written(model)
    alone = bases.where("place IS NOT NULL").orderBy("shard", "place").collect()
    split = [(int(np.frombuffer(r.hashes, np.uint64)[0]), np.frombuffer(r.base).tolist()) for r in alone]
    split_key, split_base = np.array([key for key, _ in split], np.uint64), np.array([base for _, base in split], float).reshape(-1, SAMPLES)
    floor = float(total + distinct + 1)

    def looked_up(requests: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct pairs of a shard, the place of every asked one, and where each bundle's end."""
        shard = requests.column("shard")[0].as_py()
        each = [_unpacked(payload) for payload in requests.column("payload").to_pylist()]
        asked = [numbers.keys(shard, np.cumsum(word), context) for word, context in each]
        return *_distinct(np.concatenate(asked)), np.cumsum([len(x) for x in asked])

    def begin(requests: pa.Table, words: pa.Table) -> pa.Table:
        if not requests.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "owner": pa.array([], pa.int64()), "payload": pa.array([], pa.binary()), "stats": pa.array([], pa.list_(pa.float64()))})
        shard = requests.column("shard")[0].as_py()
        keys, place, _ = looked_up(requests)
        counts = np.bincount(place, np.concatenate([_unpacked(x)[0] for x in requests.column("counts").to_pylist()]), len(keys)).astype(np.int64)
        slots, sizes = np.unique(keys // numbers.total, return_counts=True)
        own_key, own_base = (np.frombuffer(b"".join(words.column(name).to_pylist()), kind) for name, kind in (("hashes", np.uint64), ("base", float)))
        key, base = np.append(own_key, split_key), np.concatenate([own_base.reshape(-1, SAMPLES), split_base])
        own = _Seats(key[slots], np.maximum(-1, slots - len(own_key)), base[slots], sizes, keys % numbers.total, counts)
        return first_rows(own, shard, owners)

    first = written(requests.groupBy("shard").cogroup(bases.where("place IS NULL").groupBy("shard")).applyInArrow(begin, STATE), "seats")
    drop_written(bases)
    predicted = word_model(first, split, owners, arrays=False)
    scored = written(predicted, "scored")
    drop_written(predicted)

    def answer(requests: pa.Table, scored: pa.Table) -> pa.Table:
        _, place, ends = looked_up(requests)
        logp = np.frombuffer(scored.column("logp")[0].as_py(), "<f4")
        found = [x.tobytes() for x in np.split(logp[place], ends[:-1])]
        return pa.table({"bundle": requests.column("bundle"), "shard": requests.column("shard"), "word": pa.array([False] * len(found)), "payload": pa.array(found, pa.binary())})

    def finish(docs: pa.Table, table: pa.Table) -> pa.Table:
        words = table.column("word")
        docs, sizes, tokens, ids, c, pairs, place = _pairs(docs, table.filter(words), numbers)
        answers = table.filter(pc.invert(words))
        parts = sorted(zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        order = _grouped(numbers.shard(ids[pairs // len(ids)], ids[pairs % len(ids)]), shards)[0]
        logp = np.empty(len(pairs))
        logp[order] = np.frombuffer(b"".join([x for _, x in parts]), "<f4")
        known, base, logp = (c > 0)[tokens], np.log10((c + 1) / floor)[tokens], logp[place]
        starts = np.cumsum(sizes) - sizes
        sums = [pa.array(x) for x in (sizes, *(np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, logp, np.where(known, base, 0.0), np.where(known, logp, 0.0))))]
        return pa.table([docs.column("id"), docs.column("held_out"), *sums], names=["id", "held_out", "n_tokens", "n_known", *SCORES])

    answers = written(requests.select("bundle", "shard", "payload").groupBy("shard").cogroup(scored.groupBy("shard")).applyInArrow(answer, "bundle long, shard long, word boolean, payload binary"), "answers")
    drop_written(requests, scored)
    both = answers.unionByName(replies.withColumn("word", F.lit(True)))
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, " + ", ".join(f"{name} double" for name in SCORES)
    found = kept.cogroup(both.groupBy("bundle")).applyInArrow(finish, schema)
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), *SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of both models, over all tokens and over learnt ones, for rows held out and rows learnt from."""
    found = [F.pow(10.0, -F.sum(f"{part}{name}score") / F.sum(n)).alias(f"{part}{name}perplexity") for part, n in (("", "n_tokens"), ("known_", "n_known")) for name in ("base_", "")]
    return scores.groupBy("held_out").agg(*found)
