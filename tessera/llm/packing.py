"""Packing documents into training sequences of one length with a grouping genetic algorithm.

A document's size is the number of its byte-level tokens (UTF-8 bytes) and one end mark for
each piece. Documents longer than a sequence are cut into pieces; all pieces but the last
fill a sequence each. The other pieces are spread by a hash over shards of about
SHARD_ITEMS, which are packed on their own: large enough that as many sequences result as
from packing all together, but for about one in each shard.

A shard is packed by ISLANDS populations. An individual is a whole packing. The first one
comes from best fit in falling order of size, the others from best fit in disturbed orders.
Crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold a document twice, and puts the displaced documents back by best fit in falling order;
mutation empties the worst bins the same way. Fitness is the mean of the squared fill. After
each epoch the best individuals of an island move on to the next one of the ring; between
epochs the islands' states are tables, so that all islands of all shards run in parallel.

Defined results: rows with a null id or text are left out; an empty text has size 1, that of
its end mark; rows that repeat an id are packed each, however many they are: a shard's share of them is that
of other pieces; ties go to the bin opened first; a text
of any length is cut into as many pieces as it takes; an empty table gives no bin. The result
holds no other column of the input. It depends on the rows and the seed only.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spill import cut

CAPACITY = 16_384
SHARD_ITEMS = 4_096
ISLANDS, EPOCHS, POPULATION, ELITES, CHILDREN = 3, 2, 6, 2, 16
SEED = 20_240_601
#: Islands (some 200 KB each) that a task works on, one after the other, where there are more than 4,096 of them.
ISLANDS_A_TASK = 512
COPIES_AT_ONCE = 1_000


def best_fit(size: np.ndarray, order: np.ndarray, fill: list[int], bin_of: np.ndarray, capacity: int) -> None:
    """Puts the items of `order` into the fullest bin that takes each, or a new one; changes fill and bin_of."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    sizes = size[order].tolist()
    for item, s in zip(order.tolist(), sizes, strict=True):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            b = len(fill)
            fill.append(s)
            left = capacity - s
        else:
            left, b = room.pop(at)
            left -= s
            fill[b] += s
        bin_of[item] = b
        if left:
            insort(room, (left, b))


def falling(size: np.ndarray, items: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items, -size[items]))]


def packed(size: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bin_of = np.zeros(len(size), np.int32)
    best_fit(size, order, [], bin_of, capacity)
    return bin_of


def fitness(bin_of: np.ndarray, size: np.ndarray, capacity: int) -> float:
    fill = np.bincount(bin_of, weights=size)
    return float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def refill(bin_of: np.ndarray, gone: np.ndarray, injected: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """A packing without the bins marked in `gone`; `injected` gives new bins (-1: none) to items, the rest are put back by best fit."""
    out = np.full(len(size), -1, np.int32)
    stay = ~gone[bin_of] & (injected < 0)
    kept, place = np.unique(bin_of[stay], return_inverse=True)
    out[stay] = place
    new, place = np.unique(injected[injected >= 0], return_inverse=True)
    out[injected >= 0] = len(kept) + place
    displaced = np.flatnonzero(out < 0)
    n = len(kept) + len(new)
    fill = np.bincount(out[out >= 0], weights=size[out >= 0], minlength=n).astype(np.int64).tolist()
    best_fit(size, falling(size, displaced), fill, out, capacity)
    return out


def crossover(a: np.ndarray, b: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(b, weights=size)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[well[rng.random(len(well)) < 0.35]] = True
    injected = np.where(chosen[b], b, -1)
    gone = np.zeros(int(a.max()) + 1, bool)
    gone[a[injected >= 0]] = True
    return refill(a, gone, injected, size, capacity)


def mutate(a: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(a, weights=size)
    worst = np.argsort(fill, kind="stable")[: max(2, len(fill) // 20)]
    gone = np.zeros(len(fill), bool)
    gone[worst] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    return refill(a, gone, np.full(len(size), -1), size, capacity)


def evolve(size: np.ndarray, people: list[np.ndarray], capacity: int, rng: np.random.Generator, children: int = CHILDREN) -> list[np.ndarray]:
    """The population after so many children, the best first."""
    held = sorted(((fitness(p, size, capacity), -k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    least = -(-int(size.sum()) // capacity)
    for child in range(children):
        if int(held[0][2].max(initial=-1)) + 1 <= least:
            break  # no packing has fewer bins
        i, j = sorted(rng.choice(len(held), 2, replace=False)) if len(held) > 1 else (0, 0)
        new = crossover(held[i][2], held[j][2], size, capacity, rng)
        if child % 3 == 2:
            new = mutate(new, size, capacity, rng)
        held.append((fitness(new, size, capacity), -len(people) - child, new))
        held.sort(key=lambda x: x[:2], reverse=True)
        del held[POPULATION:]
    return [p for *_, p in held]


def founders(size: np.ndarray, capacity: int, island: int, rng: np.random.Generator) -> list[np.ndarray]:
    items = np.arange(len(size))
    out = [packed(size, falling(size, items), capacity)] if island == 0 else []
    while len(out) < POPULATION // 2:
        out.append(packed(size, items[np.argsort(-size * rng.uniform(0.7, 1.3, len(size)), kind="stable")], capacity))
    return out


STATE = "shard int, island int, ids array<bigint>, starts array<bigint>, sizes array<int>, people array<binary>, fit double"
BINS = "bin_id bigint, used int, doc_ids array<bigint>, pieces array<struct<doc_id:bigint,start:bigint,length:int>>"


def _list(column: pa.Array, row: int) -> np.ndarray:
    """The numbers of one row's list, as they lie in the batch."""
    return column[row].values.to_numpy(zero_copy_only=False) if column[row].is_valid else np.zeros(0, np.int64)


def _epoch(capacity: int, seed: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one island at a time, whatever the batch holds
                shard, island = batch.column("shard")[k].as_py(), batch.column("island")[k].as_py()
                size = _list(batch.column("sizes"), k).astype(np.int64)
                rng = np.random.default_rng([seed, epoch, shard, island])
                people = [np.frombuffer(p, np.int32) for c in ("people", "guests") for p in batch.column(c)[k].as_py() or []]
                inner = size[size < capacity]
                if len(inner):
                    people = evolve(inner, people or founders(inner, capacity, island, rng), capacity, rng)
                own = [batch.column(c).slice(k, 1) for c in ("shard", "island", "ids", "starts", "sizes")]
                fit = fitness(people[0], inner, capacity) if people else 0.0
                yield pa.RecordBatch.from_arrays([*own, pa.array([[p.astype(np.int32).tobytes() for p in people]], pa.list_(pa.binary())), pa.array([fit])], _STATE)

    return run


_STATE = ["shard", "island", "ids", "starts", "sizes", "people", "fit"]


def _bins(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, ids, starts = (_list(batch.column(c), k).astype(np.int64) for c in ("sizes", "ids", "starts"))
                best = np.frombuffer(batch.column("best")[k].as_py() or b"", np.int32)
                yield bins_of(batch.column("shard")[k].as_py(), size, ids, starts, best, capacity)

    return run


def bins_of(shard: int, size: np.ndarray, ids: np.ndarray, starts: np.ndarray, best: np.ndarray, capacity: int) -> pa.RecordBatch:
    """The sequences of a shard; `best` has the bins of the pieces that don't fill one."""
    open_, full = np.flatnonzero(size < capacity), np.flatnonzero(size >= capacity)
    bin_of = np.zeros(len(size), np.int64)
    bin_of[open_] = best
    bin_of[full] = int(best.max(initial=-1)) + 1 + np.arange(len(full))
    order = np.lexsort((starts, ids, bin_of))
    size, ids, starts, bin_of = size[order], ids[order], starts[order], bin_of[order]
    first = np.flatnonzero(np.diff(bin_of, prepend=-1))
    ends = np.append(first[1:], len(order)).astype(np.int64)[: len(first)]
    pieces = pa.StructArray.from_arrays([pa.array(ids), pa.array(starts), pa.array((size - 1).astype(np.int32))], ["doc_id", "start", "length"])
    once = np.flatnonzero(np.diff(ids, prepend=-1).astype(bool) | np.diff(bin_of, prepend=-1).astype(bool))
    offsets = np.append(np.searchsorted(once, first), len(once))
    return pa.RecordBatch.from_arrays(
        [
            pa.array((shard << 32) + np.arange(len(first))), pa.array(np.add.reduceat(size, first).astype(np.int32) if len(first) else np.zeros(0, np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[once])), pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1:]), pa.int32()), pieces),
        ],
        ["bin_id", "used", "doc_ids", "pieces"],
    )


def tasks_for(islands: int) -> int:
    """A task for each island while they are few, then for every ISLANDS_A_TASK."""
    return max(1, min(islands, 4096), -(-islands // ISLANDS_A_TASK))


def pieces_of(sizes: DataFrame, most: int) -> DataFrame:
    """(id, start, size, copy) of (id, n); copy tells rows apart that repeat an id and a length."""
    rows = sizes.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("bigint")
    one = rows.where("c = 1").select("id", "n", zero.alias("copy"))
    # A row may stand for a third of the table: its copies are made by many tasks.
    some = rows.where("c > 1").select("id", "n", "c", F.explode(F.sequence(zero, F.floor((F.col("c") - 1) / COPIES_AT_ONCE))).alias("at")).repartition("id", "at")
    some = some.select("id", "n", F.explode(F.sequence(F.col("at") * COPIES_AT_ONCE, F.least((F.col("at") + 1) * COPIES_AT_ONCE, F.col("c")) - 1)).alias("copy"))
    starts = F.sequence(zero, F.greatest(F.col("n") - 1, zero), F.lit(most).cast("bigint"))
    return one.unionByName(some).select("id", "n", "copy", F.explode(starts).alias("start")).select("id", "start", (F.least(F.col("n") - F.col("start"), F.lit(most)) + 1).cast("int").alias("size"), "copy")


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacity: int = CAPACITY, seed: int = SEED) -> DataFrame:
    """(bin_id, used, doc_ids, pieces): every sequence with its pieces (document, first token, tokens without the end mark)."""
    if capacity < 2:
        raise ValueError("a sequence must hold a token and its end mark")
    most = capacity - 1
    # Only ids and lengths go on from here, whatever the size of the texts.
    sizes = cut(docs.select(docs[id_col].cast("bigint").alias("id"), length.cast("bigint").alias("n")).where("id is not null and n is not null"), "lengths")
    count = sizes.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / most))), F.lit(0))).first()[0]
    shards = max(1, -(-int(count) // SHARD_ITEMS))
    pieces = pieces_of(sizes, most).select(F.pmod(F.xxhash64("id", "start", "copy", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.struct("id", "start", "size").alias("piece"))
    shard = pieces.groupBy("shard").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    islands = shard.select("shard", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island"), "p")
    none = F.lit(None).cast("array<binary>")
    state = islands.select("shard", "island", F.col("p.id").alias("ids"), F.col("p.start").alias("starts"), F.col("p.size").alias("sizes"), none.alias("people"), none.alias("guests"))
    for epoch in range(EPOCHS):
        # An island is a row; rows are spread evenly over tasks.
        state = state.repartition(tasks_for(shards * ISLANDS), "shard", "island")
        state = cut(state.mapInArrow(_epoch(capacity, seed, epoch), STATE), "islands")
        if epoch + 1 < EPOCHS:
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("people", 1, ELITES).alias("guests"))
            state = state.drop("fit").join(guests, ["shard", "island"])
    best = state.groupBy("shard").agg(F.max_by(F.struct("ids", "starts", "sizes", F.get("people", F.lit(0)).alias("best")), F.struct("fit", -F.col("island"))).alias("b"))
    return best.select("shard", "b.ids", "b.starts", "b.sizes", "b.best").mapInArrow(_bins(capacity), BINS)


def byte_tokens(text: Column) -> Column:
    """Number of byte-level tokens of a text."""
    return F.octet_length(text)


def op7_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, byte_tokens(docs["text"]))


QUERIES = {"op7_genetic_packing": op7_genetic_packing}
ORACLE_SQL: dict[str, str] = {}
