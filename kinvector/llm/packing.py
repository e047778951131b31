"""Best-fit packing by bin completion over the histogram of lengths.

Pieces of one length are interchangeable, so the search works on at most
``capacity`` (length, count) pairs, however many documents there are; that
histogram is all that reaches the driver. The search fills the bin around the
largest remaining length with undominated fillings of any number of pieces,
least waste first, applies a filling as often as the counts allow, gives a branch
up as soon as its waste shows that it can't beat the incumbent, and goes back to
the last bin with another filling until the bound is met or its work is done.
The incumbent is the best of some quick descents. Spark then ranks the pieces
within their length (salted, so that a frequent length isn't one task) and
each piece takes the slot of its rank.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvector.llm.common import blocks, cut, release, sliced
from kinvector.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's bound on the number of bins; counts[length] up to the capacity."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):  # lengths above capacity - k share no bin with those of k or more
        big = int(n[-1] - n[capacity - k])
        middle = int(n[capacity - k] - n[capacity // 2])
        room = middle * capacity - int(total[capacity - k] - total[capacity // 2])
        small = int(total[capacity // 2] - (total[k - 1] if k else 0))
        best = max(best, big + middle + max(0, -(-(small - room) // capacity)))
    return best


def covers(large: tuple, small: tuple) -> bool:
    """Whether the small lengths can be dealt into the large ones (Martello and Toth's dominance)."""
    if not small:
        return True
    for i, x in enumerate(large):
        if x >= small[0] and x not in large[:i] and covers((*large[:i], x - small[0], *large[i + 1 :]), small[1:]):
            return True
    return False


def reachable(room: int, counts: np.ndarray):
    """Lengths, how often each is there, and after each the set of sums (as bits) that it and smaller ones make."""
    sizes = np.flatnonzero(counts[1 : room + 1]) + 1
    have, sums, now, full = np.minimum(counts[sizes], room // sizes).tolist(), [1], 1, (1 << room + 1) - 1
    for size, left in zip(sizes.tolist(), have):
        step = 1
        while left:
            step = min(step, left)
            now |= now << step * size & full
            left, step = left - step, step * 2
        sums.append(now)
    return sizes.tolist(), have, sums


def splits(target: int, sizes: list, have: list, sums: list):
    """All multisets of the lengths with the sum ``target``, larger lengths first; no branch is in vain."""
    stack = [(target, len(sizes), ())]
    while stack:
        rest, i, taken = stack.pop()
        if rest == 0:
            yield taken
            continue
        while sizes[i - 1] > rest:
            i -= 1
        size = sizes[i - 1]
        for k in range(min(have[i - 1], rest // size) + 1):
            if sums[i - 1] >> rest - k * size & 1:
                stack.append((rest - k * size, i - 1, taken + (size,) * k))


def fillings(room: int, counts: np.ndarray):
    """Undominated fillings of the room by any number of pieces, least waste first, larger lengths first.

    Fillings that were given already and dominate another one leave it out. None
    stands for such a one, so that the search can count the work.
    """
    if room and counts[room]:
        yield (room,)  # one piece that fills the room dominates all else
        return
    seen = []
    a = np.arange(room - 1, (room - 1) // 2, -1)
    for i in np.flatnonzero((counts[a] > 0) & (counts[room - a] > (a == room - a))):
        seen.append((int(a[i]), room - int(a[i])))
        yield seen[-1]
    sizes, have, sums = reachable(room, counts)
    for target in range(room, -1, -1):
        if sums[-1] >> target & 1:
            if target and counts[target]:
                yield None if any(covers(x, (target,)) for x in seen) else (target,)
                return
            for x in splits(target, sizes, have, sums):
                if any(covers(y, x) for y in seen):
                    yield None
                else:
                    seen.append(x)
                    yield x


def close_fillings(room: int, counts: np.ndarray, most_waste: int):
    """Some fillings of the room by up to three lengths, least waste first, larger lengths first: for incumbents."""
    least = next(iter(np.flatnonzero(counts[: room + 1])), room + 1)  # the smallest length bounds how many fit
    for waste in range(min(room, most_waste) + 1):
        target = room - waste
        if target == 0:
            yield waste, ()
            continue
        if counts[target]:
            yield waste, (target,)
            continue  # one piece that fills the room dominates every split of it
        if target < 2 * least:
            continue
        a = np.arange(target - 1, (target - 1) // 2, -1)
        b = target - a
        pairs = np.flatnonzero((counts[a] > 0) & (counts[b] > (a == b)))
        for i in pairs[:4]:
            yield waste, (int(a[i]), int(b[i]))
        if len(pairs) or target < 3 * least:
            continue
        for first in np.flatnonzero(counts[1:target])[::-1][:16] + 1:
            rest = target - first
            a = np.arange(min(first, rest - 1), (rest - 1) // 2, -1)
            if not len(a):
                continue
            b = rest - a
            ok = np.flatnonzero((counts[a] > (a == first)) & (counts[b] > (b == first) + (a == b).astype(int)))
            if len(ok):
                yield waste, (int(first), int(a[ok[0]]), int(b[ok[0]]))
                break


def largest_fit(room: int, counts: np.ndarray):
    """Largest length that fits, again and again: the filling when no close one exists."""
    out, left = [], counts
    while room > 0 and len(fit := np.flatnonzero(left[1 : room + 1])):
        out.append(int(fit[-1]) + 1)
        left = left.copy() if left is counts else left
        left[out[-1]] -= 1
        room -= out[-1]
    return room, tuple(out)


def descend(counts: np.ndarray, turn: int, spare: int):
    """One quick descent: [(lengths, times)], or None once its waste exceeds ``spare``.

    ``turn`` numbers the discrepancies: its bits tell at which of the first
    levels the second filling is taken in place of the first.
    """
    capacity, counts, out, waste, level = len(counts) - 1, counts.copy(), [], 0, 0
    while len(have := np.flatnonzero(counts)):
        largest = int(have[-1])
        counts[largest] -= 1
        room, filled = capacity - largest, []
        options = []
        for _, x in close_fillings(room, counts, 12):
            options.append(x)
            if len(options) > (turn >> level & 1):
                break
        x = options[-1] if options else largest_fit(room, counts)[1]
        filled = [largest, *x]
        counts[largest] += 1
        size, uses = np.unique(filled, return_counts=True)
        times = int((counts[size] // uses).min())
        counts[size] -= uses * times
        waste += times * (capacity - sum(filled))
        out.append((tuple(filled), times))
        level += 1
        if waste > spare and counts.any():
            return None
    return out


def incumbent(counts: np.ndarray, turns: int = 16, levels: int = 8000) -> list[tuple[tuple[int, ...], int]]:
    """The best of some quick descents, which the search has to beat: [(lengths, times)]."""
    total, bound = int((counts * np.arange(len(counts))).sum()), lower_bound(counts)
    best, fewest = None, None
    for turn in range(turns):
        if best is not None and (turn + 1) * len(best) > levels:
            break
        spare = (fewest - 1) * (len(counts) - 1) - total if best is not None else total + len(counts) * int(counts.sum())
        found = descend(counts, turn, spare)
        if found is not None and (best is None or sum(t for _, t in found) < fewest):
            best, fewest = found, sum(t for _, t in found)
        if fewest is not None and fewest <= bound:
            break
    return best or []


def complete(counts: np.ndarray, turn: int, spare: int, work: int | None):
    """Depth-first search: ([(lengths, times)] or None once nothing is left to try or the work is done, work done).

    A branch ends once its waste exceeds ``spare``; the search then goes back to
    the last bin with another filling. ``turn`` numbers the discrepancies: its
    bits tell at which of the first levels the search begins with the second
    filling.
    """
    capacity, counts, out, steps = len(counts) - 1, counts.copy(), [], []
    done, waste, skip = 0, 0, turn & 1
    while len(have := np.flatnonzero(counts)):
        if work is not None and done >= work:
            return None, done
        largest, x, k = int(have[-1]), None, -1
        counts[largest] -= 1
        begun = len(steps) < 4 and skip == turn >> len(steps) & 1
        for k, found in enumerate(fillings(capacity - largest, counts)):
            done += 1
            if found is not None and (k >= skip or begun and x is None):
                x, at = found, k
                if k >= skip:
                    break
            if work is not None and done >= work:
                break
        counts[largest] += 1
        if x is not None:
            filled = (largest, *x)
            size, uses = np.unique(filled, return_counts=True)
            times = int((counts[size] // uses).min())
            more = times * (capacity - sum(filled))
        if x is None or waste + more > spare:
            if x is not None and at >= skip:
                skip = at + 1  # another filling of the same bin
                continue
            if not steps:
                return None, done
            skip, size, used, more = steps.pop()
            counts[size] += used
            waste -= more
            out.pop()
            continue
        counts[size] -= uses * times
        waste += more
        out.append((filled, times))
        steps.append((at + 1, size, uses * times, more))
        skip = turn >> len(steps) & 1 if len(steps) < 4 else 0
    return out, done


def bin_completion(counts: np.ndarray, turns: int = 16, work: int = 8000) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with their numbers of bins for counts[length], length 1 to the capacity.

    The incumbent and a first descent go to their ends; improvements share ``work``
    fillings, whatever the number of documents, dealt evenly to the turns.
    """
    capacity = len(counts) - 1
    total, bound = int((counts * np.arange(len(counts))).sum()), lower_bound(counts)
    best = incumbent(counts)
    if sum(t for _, t in best) > bound:
        best = min(complete(counts, 0, total + len(counts) * int(counts.sum()), None)[0], best, key=lambda x: sum(t for _, t in x))
    fewest = sum(t for _, t in best)
    for turn in range(turns):
        left = work // turns
        while left > 0 and fewest > bound:
            found, done = complete(counts, turn, (fewest - 1) * capacity - total, left)
            left -= max(1, done)
            if found is None:
                break
            best, fewest = found, sum(t for _, t in found)
    return best


def pack(pieces: DataFrame, capacity: int, salt_rows: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a written table: it is read twice.
    """
    hist = pieces.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    slots: dict[int, list[tuple[int, ...]]] = {}
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for filled, times in bin_completion(counts):
        offset = 0
        size, uses = np.unique(filled, return_counts=True)
        for length, k in zip(size.tolist(), uses.tolist()):
            slots.setdefault(length, []).append((int(used[length]), sequence, k, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    slots = {length: np.array(x, np.int64) for length, x in slots.items()}

    salts = max(1, -(-int(counts.max(initial=0)) // salt_rows))
    others = [c for c in pieces.columns if c != "length"]
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64("length", *others), F.lit(salts)).cast("int"))
    before = rows.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*others)).cast("long") - 1
    rows = rows.withColumn("_rank", rank).join(before, ["length", "_salt"]).select(*pieces.columns, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def place(batches):
        import pyarrow as pa

        release()  # encoders of the step before
        for batch in batches:
            length, at = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                first, base, k, start = slots[one][np.searchsorted(slots[one][:, 0], at[mine], "right") - 1].T
                sequence[mine] = base + (at[mine] - first) // k
                offset[mine] = start + (at[mine] - first) % k * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return rows.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, keeps_blanks: bool = False, most_words: int = 600_000) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids: doc_id, piece, start, length, ids_crc32.

    ``most_words`` bounds the encoder's table of words in each Python worker
    (about 0.4 KB a word); fewer words cost time and change no id.
    """

    def cut_up(batches):
        import pyarrow as pa

        mine = encoder(tokenizer, keeps_blanks, most_words)
        for batch in sliced(batches, keep=True):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for some in blocks(rows, lambda r: len(r[1] or ""), min(4_000_000, 8 * most_words)):
                out = []
                for (doc_id, _), ids in zip(some, mine.encode([t or "" for _, t in some])):
                    ids = ids.astype("<u4")
                    out += [(doc_id, k, s, len(x := ids[s : s + capacity]), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut_up, PIECE)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, keeps_blanks: bool = False, most_words: int = 600_000) -> DataFrame:
    """Packs whole documents into as few sequences of ``capacity`` tokens as it can.

    A document is its token ids and an end id 0; only longer documents are cut,
    into pieces of ``capacity``, the last one shorter. Returns a row per piece:
    doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit
    ids), sequence_id, offset. ``most_words`` bounds each Python worker's memory
    (see ``pieces_of``).

    Defined cases: a null or empty text is the end id alone; repeated rows and
    rows that share a doc_id, null ones too, are packed each; other columns are
    ignored; an empty table gives no rows.
    """
    return pack(cut(pieces_of(docs, tokenizer, capacity, keeps_blanks, most_words)), capacity)
