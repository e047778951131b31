"""One gallery for many cameras, matched by many tasks.

What a gallery does with a detection depends on all that it did before, so the
updates are sequential. Scoring is not: the detections of an epoch (a run of
frames, of about ``epoch_rows`` rows) are scored by as many tasks as they have
partitions against the gallery as it stood when the epoch began, and each keeps
its ``top`` best entities and a bound of the others. The sequential part then
scores a frame's detections, as one matrix, with the entities that have changed
since. Where the bounds don't settle a detection, it is scored in full, so the
result is that of ``gallery.assign``.

No task holds more than an epoch, and the state between two epochs is a written
table (``gallery.SAVED``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.operators import gallery as online
from kinvector.operators.retrieval import SENT_BYTES, matrix
from kinvector.operators.scan import numbered, running_sum
from kinvector.sources.shared import folder, written

HINTED = "gallery_id long, camera_id long, frame_id long, event_id long, embedding array<double>, conf double, t double, top array<int>, top_scores array<double>, rest double"
OUT = f"kind string, assigned struct<{online.ASSIGNED.replace(' ', ':').replace(',:', ',')}>, saved struct<{online.SAVED.replace(' ', ':').replace(',:', ',')}>"
SLACK = 1e-9
MATCHED = 1024  # detections of a frame that are scored at once


def epochs_of(found: DataFrame, epoch_rows: int) -> tuple[DataFrame, int]:
    """(rows with their epoch, written once by epoch; how many epochs): frames are not split."""
    frames = running_sum(numbered(found.groupBy("frame_id").agg(F.count("*").alias("n")), ["frame_id"]), {"upto": F.col("n")})
    at = written(frames.select(F.col("frame_id").alias("_f"), F.floor((F.col("upto") - F.col("n")) / epoch_rows).cast("int").alias("epoch")))
    rows = found.select(*online.NEEDED).join(at, F.col("frame_id") == F.col("_f")).drop("_f")
    path = folder(found.sparkSession)
    rows.write.partitionBy("epoch").parquet(path)
    n = at.agg(F.max("epoch")).first()[0]
    return found.sparkSession.read.schema(rows.schema).parquet(path), 0 if n is None else n + 1


def hinted(rows: DataFrame, saved: DataFrame | None, top: int) -> DataFrame:
    """``rows`` with the places and scores of the ``top`` nearest entities of their gallery in ``saved``, and a bound of all others.

    Places follow the order of insertion, and are -1 where there are fewer entities. The centroids go to every task: the
    caller has checked that they are few.
    """
    held = {}
    if saved is not None:
        for r in saved.where("entity_id is not null").select("gallery_id", "ins_seq", "centroid").orderBy("gallery_id", "ins_seq").collect():
            held.setdefault(r["gallery_id"], []).append(r["centroid"])
    sent = rows.sparkSession.sparkContext.broadcast({who: online.scaled(np.array(c, float)) for who, c in held.items()})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            who, v = np.array(batch.column("gallery_id").to_pylist(), object), matrix(batch.column("embedding"))
            places, scores, rest = np.full((len(who), top), -1, np.int32), np.full((len(who), top), -2.0), np.full(len(who), -2.0)
            for one in set(who) & set(sent.value):
                mine = np.flatnonzero(who == one)
                s = np.round(online.scaled(v[mine]) @ sent.value[one].T, 12)
                k = min(top, s.shape[1])
                best = np.argpartition(-s, k - 1, 1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(mine), 1))
                places[mine, :k], scores[mine, :k] = best, np.take_along_axis(s, best, 1)
                np.put_along_axis(s, best, -2.0, 1)
                rest[mine] = s.max(1)
            ends = pa.array(np.arange(len(who) + 1) * top, pa.int32())
            columns = [*(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (places, scores)), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in online.NEEDED], *columns], names=online.names_of(HINTED))

    return rows.select(*online.NEEDED).mapInArrow(run, HINTED)


class Fresh:
    """Scaled centroids of entities inserted since an epoch began, in their order, as one array."""

    def __init__(self):
        self.ids, self.row, self.n, self.v, self.alive = [], {}, 0, None, None

    def put(self, i: int, u: np.ndarray):
        if i not in self.row:
            if self.v is None or self.n == len(self.v):
                self._make_room(len(u))
            self.row[i] = self.n
            self.ids.append(i)
            self.alive[self.n] = True
            self.n += 1
        self.v[self.row[i]] = u

    def drop(self, i: int):
        if i in self.row:
            self.alive[self.row.pop(i)] = False

    def _make_room(self, wide: int):
        """Leaves out those that are gone; the array then has room for as many again."""
        keep = np.flatnonzero(self.alive[: self.n]) if self.n else np.zeros(0, int)
        room = max(64, 2 * len(keep))
        v, alive = np.zeros((room, wide)), np.zeros(room, bool)
        if len(keep):
            v[: len(keep)] = self.v[keep]
        alive[: len(keep)] = True
        self.ids = [self.ids[k] for k in keep]
        self.row, self.n, self.v, self.alive = {i: k for k, i in enumerate(self.ids)}, len(keep), v, alive

    def nearest(self, q: np.ndarray) -> tuple:
        """(entity, score) of the highest score with a vector, or with each of several, of the first inserted; -3 without entities."""
        if not self.row:
            return np.full(q.shape[:-1], -1), np.full(q.shape[:-1], -3.0)
        s = np.where(self.alive[: self.n], np.round(q @ self.v[: self.n].T, 12), -3.0)
        return np.array(self.ids)[s.argmax(-1)], s.max(-1)


class Hints:
    """The scores of an epoch's start, and what has changed since."""

    def __init__(self, gallery: online.Gallery):
        self.g = gallery
        self.ids = list(gallery.entities)
        self.place = {i: k for k, i in enumerate(self.ids)}
        self.start = online.scaled(np.stack([gallery.entities[i].centroid for i in self.ids])) if self.ids else None
        self.now = None if self.start is None else self.start.copy()
        self.alive, self.moved = np.ones(len(self.ids), bool), np.zeros(len(self.ids), bool)
        self.fresh = Fresh()
        self.full = 0
        gallery.changed, gallery.removed = set(), set()

    def follow(self):
        """Takes notice of the last frame's changes."""
        for i in self.g.removed:
            if i in self.place:
                self.alive[self.place[i]] = False
            self.fresh.drop(i)
        ids = list(self.g.changed)
        if ids:
            places = [self.place.get(i, -1) for i in ids]
            for i, k, u in zip(ids, places, online.scaled(np.stack([self.g.entities[i].centroid for i in ids]))):
                if k >= 0 and self.alive[k]:
                    self.now[k], self.moved[k] = u, True
                else:
                    self.fresh.put(i, u)
        self.g.changed, self.g.removed = set(), set()

    def nearest(self, q: np.ndarray, top: np.ndarray, scores: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entities, scores) of scaled vectors: the highest score, then the first inserted; what ``Gallery.match`` finds."""
        last, fresh = self.fresh.nearest(q)  # inserted after all others
        if self.start is None:
            return last, fresh
        rows, far = np.arange(len(q)), len(self.ids)
        still = self.alive & ~self.moved
        held = (top >= 0) & still[top]
        scores = np.where(held, scores, -3.0)
        best = scores.max(1)
        who = np.where(held & (scores == best[:, None]), top, far).min(1)
        some = np.flatnonzero(self.alive & self.moved)
        if len(some):
            s = np.round(q @ self.now[some].T, 12)
            k = s.argmax(1)  # the first of the highest
            s, k = s[rows, k], some[k]
            nearer = (s > best) | ((s == best) & (k < who))
            best, who = np.where(nearer, s, best), np.where(nearer, k, who)
        open_yet = np.flatnonzero((np.maximum(best, fresh) <= rest + SLACK) & (held.sum(1) < still.sum()))
        if len(open_yet):
            self.full += len(open_yet)
            s = np.where(self.alive, np.round(q[open_yet] @ self.now.T, 12), -3.0)
            best[open_yet], who[open_yet] = s.max(1), s.argmax(1)
        ids = np.array([*self.ids, -1])[who]
        return np.where(fresh > best, last, ids), np.maximum(fresh, best)

    def matched(self, rows: list) -> list[tuple[int, str, float]]:
        self.follow()  # also of prunes between two frames
        if self.g.is_empty():
            return [(-1, "new", 0.0)] * len(rows)
        out = []
        for at in range(0, len(rows), MATCHED):
            v, top, scores, rest = zip(*rows[at : at + MATCHED])
            found = self.nearest(online.scaled(np.stack(v)), np.stack(top).astype(int), np.stack(scores), np.array(rest))
            out += [self.g.told(*x) for x in zip(*(c.tolist() for c in found))]
        return out


def folded_epoch(rows: DataFrame, saved: DataFrame | None, settings: online.Settings) -> DataFrame:
    """Assignments of an epoch's hinted rows, and the galleries after it, told apart by ``kind``."""
    names = online.names_of(HINTED)[7:]

    def run(batches):
        import pyarrow as pa

        kinds = {"assigned": (online.ASSIGNED, (0, 0, 0, 0, 0, "", 0.0, True)), "saved": (online.SAVED, online.Gallery(settings).saved(0)[0])}
        empty = {k: pa.struct(next(online.arrow([row], schema)).schema) for k, (schema, row) in kinds.items()}

        def out(kind, found):
            columns = [pa.array([kind] * len(found), pa.string())]
            for k, (schema, _) in kinds.items():
                batch = next(online.arrow(found, schema), None) if k == kind else None
                columns.append(pa.nulls(len(found), empty[k]) if batch is None else pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)))
            return pa.RecordBatch.from_arrays(columns, names=["kind", *kinds])

        now, g, hints, done = None, None, None, []

        def walk():
            nonlocal now, g, hints, done
            for who, one, rows in online.frames(batches, tuple(names)):
                if g is None or who != now:
                    if g is not None:
                        yield out("saved", g.saved(now))
                    now, g, hints = who, online.Gallery(settings), None
                if one is not None:
                    g.take(one)
                    continue
                hints = hints or Hints(g)
                found = g.frame([(v, conf, t, frame) for _, frame, _, v, conf, t, *_ in rows], lambda: hints.matched([(r[3], *r[6:]) for r in rows]))
                done += online.assigned_rows(who, rows, found)
                if len(done) >= 5000:
                    yield out("assigned", done)
                    done = []
            if g is not None:
                yield out("saved", g.saved(now))
            yield out("assigned", done)

        yield from walk()

    return online.ordered(rows, saved, tuple(names)).mapInArrow(run, OUT)


def assign(found: DataFrame, settings: online.Settings = online.Settings(), epoch_rows: int = 50_000, top: int = 32, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(``gallery.assign`` of the rows, the galleries after the last epoch as ``gallery.SAVED``).

    Epochs follow each other, a job each; an empty table gives no rows and the
    galleries of ``start``.
    """
    spark = found.sparkSession
    rows, n = epochs_of(found, epoch_rows)
    galleries, wide = rows.agg(F.count_distinct("gallery_id"), F.max(F.size("embedding"))).first()
    if (galleries or 0) * settings.max_size * (wide or 1) * 8 > SENT_BYTES:
        raise ValueError("too many galleries for one array: they are folded in parallel by gallery.assign")
    path, saved = folder(spark), start
    done = []
    for epoch in range(n):
        at = f"{path}/{epoch}"
        hints = hinted(rows.where(F.col("epoch") == epoch), saved, top)
        folded_epoch(hints, saved, settings).write.parquet(at)
        done.append(at)
        saved = spark.read.schema(OUT).parquet(at).where("kind = 'saved'").select("saved.*")  # of galleries without rows in this epoch too
    out = spark.read.schema(OUT).parquet(*done) if done else spark.createDataFrame([], OUT)
    return out.where("kind = 'assigned'").select("assigned.*"), saved
