"""Online gallery: match each frame against a bounded set of entities, then update, insert and prune.

One gallery is one sequential fold; galleries run in parallel. Rows are sorted
in ranges of ``RUN_ROWS`` by many tasks and written to the shared folder; the task
of a gallery reads its files one after the other: it holds one gallery, of
``max_size`` entities with ``keep`` observations each, one frame and a batch of
rows, and sorts nothing. A gallery may begin with a saved one (``SAVED``): exactly as it was left, or as a snapshot
is loaded, with one buffered observation for each entity.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvector.operators.retrieval import matrix
from kinvector.sources.shared import folder, open_shared

ASSIGNED = "gallery_id long, camera_id long, frame_id long, event_id long, track_id long, decision string, score double, admitted boolean"
SNAPSHOT = "gallery_id long, entity_id long, ins_seq long, centroid array<double>, confidence double, first_seen double, last_seen double, last_frame_id long, frames_since_seen int, appearance_count int, avg_confidence double, max_confidence double, buffer_size int"
#: What is kept of an entity, and of a gallery besides its entities.
ENTITY = "ins_seq long, centroid array<double>, confidence double, first_seen double, last_seen double, last_frame_id long, seen_prune long, appearance_count int, avg_confidence double, max_confidence double, buffer array<array<double>>, buffer_confidence array<double>"
COUNTERS = "next_id long, tick long, prunes long, next_seq long, current_ttl int, total_added int, total_pruned int, match_decisions int, uncertain_decisions int, new_decisions int, newest_frame long"
#: Saved galleries: a row for each entity, and one with the counters, which has no entity_id.
SAVED = f"gallery_id long, entity_id long, {ENTITY}, {COUNTERS}"
SAMPLE_EVERY = 30
#: Rows that a task sorts, galleries' rows that it reads at once, and tasks that fold galleries (more where more partitions are set).
RUN_ROWS, READ_ROWS, TASKS = 100_000, 2_000, 200


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Settings:
    max_size: int = 500
    keep: int = 10
    match: float = 0.70
    new: float = 0.50
    admit: float = 0.91
    ttl_crowded: int = 30
    ttl_sparse: int = 150
    alpha_sure: float = 0.3
    alpha_unsure: float = 0.1
    tick_every: int = 10
    ticks: bool = True  # a gallery shared by several streams never ticks
    gaps: bool = True  # numbers missing between two frames are frames without detections, which tick too
    smooth: bool = True  # else a centroid is recomputed from the buffered observations of ``quality``
    quality: float = 0.7
    force: bool = False  # admit without looking at confidence


@dataclass
class Entity:
    centroid: np.ndarray
    confidence: float
    seen: float
    frame: int
    sequence: int
    first_seen: float = 0.0
    since: int = 0  # the gallery's prunes when it was last seen
    count: int = 0
    average: float = 0.0
    most: float = 0.0
    buffer: list = field(default_factory=list)

    def row(self) -> tuple:
        """Values of ``ENTITY``."""
        return (self.sequence, self.centroid.tolist(), self.confidence, self.first_seen, self.seen, self.frame, self.since, self.count, self.average, self.most, [v.tolist() for v, _ in self.buffer], [c for _, c in self.buffer])

    @classmethod
    def of(cls, ins_seq, centroid, confidence, first_seen, last_seen, last_frame_id, seen_prune, appearance_count, avg_confidence, max_confidence, buffer, buffer_confidence) -> Entity:
        held = [(np.asarray(v, float), c) for v, c in zip(buffer, buffer_confidence)]
        return cls(np.asarray(centroid, float), confidence, last_seen, last_frame_id, ins_seq, first_seen, seen_prune, appearance_count, avg_confidence, max_confidence, held)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by their norm plus a small constant, as in cosine scores."""
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-8)


class Gallery:
    """Insertion-ordered entities and counters."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.clear()

    def clear(self):
        self.entities: dict[int, Entity] = {}
        self.next_id = self.tick = self.prunes = self.sequence = self.pruned = self.added = 0
        self.ttl, self.newest = self.s.ttl_sparse, None
        self.decisions = {"match": 0, "uncertain": 0, "new": 0}
        self.sizes: list[tuple[int, int, int]] = []  # (first tick, how many, size): what was sampled and not yet given out
        self.changed, self.removed = set(), set()  # ids, for those who store entities one by one

    def counters(self) -> tuple:
        """Values of ``COUNTERS``."""
        return (self.next_id, self.tick, self.prunes, self.sequence, self.ttl, self.added, self.pruned, *self.decisions.values(), self.newest)

    def recall(self, next_id, tick, prunes, next_seq, current_ttl, total_added, total_pruned, match_decisions, uncertain_decisions, new_decisions, newest_frame):
        """Takes over saved counters."""
        self.next_id, self.tick, self.prunes, self.sequence, self.ttl, self.added, self.pruned, self.newest = next_id, tick, prunes, next_seq, current_ttl, total_added, total_pruned, newest_frame
        self.decisions = {"match": match_decisions, "uncertain": uncertain_decisions, "new": new_decisions}

    def is_full(self) -> bool:
        return len(self.entities) >= self.s.max_size

    def is_empty(self) -> bool:
        return not self.entities

    def told(self, entity: int, score: float) -> tuple[int, str, float]:
        """Decision on a nearest entity, which is counted."""
        what = "match" if score >= self.s.match else "uncertain" if score >= self.s.new else "new"
        self.decisions[what] += 1
        return -1 if what == "new" else entity, what, score

    def match(self, vectors: np.ndarray) -> list[tuple[int, str, float]]:
        """Nearest entity, decision and score of each vector; ties go to the entity inserted first.

        In an empty gallery all are new, which counts as no decision.
        """
        if self.is_empty():
            return [(-1, "new", 0.0)] * len(vectors)
        ids = list(self.entities)
        scores = np.round(scaled(vectors) @ scaled(np.stack([self.entities[i].centroid for i in ids])).T, 12)
        return [self.told(ids[best], float(row[best])) for row, best in zip(scores, scores.argmax(1))]

    def update(self, entity_id: int, vector: np.ndarray, conf: float, t: float, frame: int) -> bool:
        e = self.entities.get(entity_id)
        if e is None:
            return False
        e.buffer = [*e.buffer, (vector, conf)][-self.s.keep :]
        if self.s.smooth:
            alpha = self.s.alpha_sure if conf > 0.7 else self.s.alpha_unsure
            e.centroid = unit(alpha * vector + (1 - alpha) * e.centroid)
        elif good := [(v, w) for v, w in e.buffer if w >= self.s.quality]:
            confs = [w for _, w in e.buffer]
            e.centroid = unit(np.average([v for v, _ in good], axis=0, weights=[w for _, w in good]))
            e.average, e.most = float(np.mean(confs)), max(confs)
        e.seen, e.frame, e.since, e.count, e.confidence = t, frame, self.prunes, e.count + 1, max(e.confidence, conf)
        self.changed.add(entity_id)
        return True

    def put(self, entity_id: int, entity: Entity):
        """A new entity comes after all; one that is there is replaced in its place."""
        old = self.entities.get(entity_id)
        entity.sequence = old.sequence if old is not None else self.sequence
        self.sequence = max(self.sequence, entity.sequence + 1)
        self.entities[entity_id] = entity
        self.changed.add(entity_id)

    def insert(self, entity_id: int, vector: np.ndarray, conf: float, t: float, frame: int) -> bool:
        if conf < self.s.admit and not self.s.force:
            return False
        if self.is_full():
            self.prune(1)
        self.put(entity_id, Entity(vector, conf, t, frame, 0, t, self.prunes, average=conf, most=conf, buffer=[(vector, conf)]))
        self.next_id, self.added = max(self.next_id, entity_id + 1), self.added + 1
        return True

    def load(self, entity_id: int, centroid: np.ndarray, conf: float, first_seen: float, seen: float, count: int):
        """Takes over an entity of a snapshot: its centroid is the one buffered observation; one that is there is replaced in its place."""
        self.put(entity_id, Entity(centroid, conf, seen, 0, 0, first_seen, self.prunes, count, buffer=[(centroid, conf)]))
        self.next_id = max(self.next_id, entity_id + 1)

    def prune(self, force: int = 0):
        """Ages all entities; drops those unseen for too many prunes and the ``force`` longest unseen."""
        if self.is_empty():
            return
        self.ttl = self.s.ttl_crowded if len(self.entities) / self.s.max_size > 0.8 else self.s.ttl_sparse
        self.prunes += 1
        gone = [i for i, e in self.entities.items() if self.prunes - e.since > self.ttl]
        gone += nsmallest(force, self.entities, key=lambda i: self.entities[i].seen)
        for i in dict.fromkeys(gone):
            del self.entities[i]
            self.pruned += 1
            self.changed.discard(i)
            self.removed.add(i)

    def end_frame(self):
        self.idle(1)

    def idle(self, frames: int):
        """Ticks of so many frames. An empty gallery has nothing to prune, so however many there are it takes few steps."""
        end = self.tick + max(0, frames)
        while self.tick < end:
            at = min((self.tick // n + 1) * n for n in (self.s.tick_every, SAMPLE_EVERY))
            if self.is_empty() or at > end:
                samples = end // SAMPLE_EVERY - self.tick // SAMPLE_EVERY
                if samples:
                    self.sizes.append(((self.tick // SAMPLE_EVERY + 1) * SAMPLE_EVERY, samples, 0))
                self.tick = end
                return
            self.tick = at
            if at % self.s.tick_every == 0:
                self.prune()
            if at % SAMPLE_EVERY == 0:
                self.sizes.append((at, 1, len(self.entities)))

    def idle_until(self, frame: int):
        """Ticks of the frames after the newest one that have come to their end without detections, ``frame`` the last of them."""
        if self.s.ticks and self.s.gaps and self.newest is not None and frame > self.newest:
            self.idle(frame - self.newest)
            self.newest = frame

    def frame(self, rows: list[tuple], matched=None) -> list[tuple]:
        """(track_id, decision, score, admitted) of a frame's rows (vector, conf, t, frame_id); ``matched`` stands in for ``match`` of their vectors."""
        self.idle_until(rows[0][3] - 1)
        out = []
        for (vector, conf, t, frame), (entity, what, score) in zip(rows, matched() if matched else self.match(np.stack([r[0] for r in rows]))):
            if what == "new":
                label = self.next_id
                admitted = self.insert(label, vector, conf, t, frame)
            else:
                label, admitted = entity, self.update(entity, vector, conf, t, frame)
            out.append((label, what, score, admitted))
        if self.s.ticks:
            self.end_frame()
        self.newest = max(rows[0][3], rows[0][3] if self.newest is None else self.newest)
        return out

    def take(self, row: dict):
        """A row of ``SAVED``; counters come before entities."""
        if row["entity_id"] is None:
            self.recall(*[row[n] for n in names_of(COUNTERS)])
        else:
            entity = Entity.of(*[row[n] for n in names_of(ENTITY)])
            self.entities[row["entity_id"]] = entity
            self.sequence, self.next_id = max(self.sequence, entity.sequence + 1), max(self.next_id, row["entity_id"] + 1)

    def saved(self, who: int) -> list[tuple]:
        """Rows of ``SAVED``."""
        none = (None,) * len(names_of(COUNTERS))
        return [(who, None, *(None,) * len(names_of(ENTITY)), *self.counters()), *[(who, i, *e.row(), *none) for i, e in self.entities.items()]]


NEEDED = ("gallery_id", "camera_id", "frame_id", "event_id", "embedding", "conf", "t")
ORDER = ("gallery_id", "saved", "frame_id", "camera_id", "event_id")


def begun(found: DataFrame, start: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``found`` and of ``start`` (``SAVED``, or a snapshot to load), which ``ORDER`` puts before a gallery's first frame, counters first."""
    rows = found.select(*NEEDED, *more, F.lit(1).alias("saved"))
    if start is not None:
        start = start if "buffer" in start.columns else loaded(start)
        held = F.struct(*names_of(SAVED)).alias("held")
        rows = rows.withColumn("held", F.lit(None).cast(f"struct<{SAVED.replace(' ', ':').replace(',:', ',')}>"))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("camera_id", "long"), ("event_id", "long"), ("embedding", "array<double>"), ("conf", "double"), ("t", "double"))]
        none += [F.lit(None).cast(dict(found.dtypes)[n]).alias(n) for n in more]
        rows = rows.unionByName(start.select("gallery_id", F.coalesce("ins_seq", F.lit(-1)).alias("frame_id"), *none, F.lit(0).alias("saved"), held))
    return rows


def ordered(found: DataFrame, start: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``begun`` in their order, a gallery in one task: for few rows, as of an epoch."""
    return begun(found, start, more).repartition("gallery_id").sortWithinPartitions(*ORDER)


@contextmanager
def partitions(spark, least: int):
    """Joins of what runs inside are dealt over at least so many partitions: Spark puts small ones together again, but parts no large one without skew."""
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    spark.conf.set(name, max(int(given), least))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def runs(found: DataFrame, start: DataFrame | None = None) -> tuple[str, list[int]]:
    """(shared folder with the rows of ``begun`` in their order, its tasks): a task's galleries lie in the files of its own folder, by number.

    The joins that make ``found`` are dealt by its rows too, however few partitions are set.
    """
    spark = found.sparkSession
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = begun(found, start).withColumn("task", F.pmod(F.xxhash64("gallery_id"), F.lit(tasks)))
    with partitions(spark, TASKS):  # rows without vectors
        held = {r["task"]: r["count"] for r in rows.groupBy("task").count().collect()}  # a row for each task
    n = max(1, -(-sum(held.values()) // RUN_ROWS))
    path = folder(spark)
    with partitions(spark, n):
        rows.repartitionByRange(n, "task", *ORDER).sortWithinPartitions("task", *ORDER).write.partitionBy("task").parquet(path)
    return path, sorted(held)


def read_runs(path: str, task: int):
    """Arrow batches of a task's rows, in their order."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, root = open_shared(f"{path}/task={task}")
    files = [f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".parquet")]
    for file in sorted(files, key=lambda f: (int(f.rsplit("/part-", 1)[1].split("-", 1)[0]), f)):
        with fs.open_input_file(file) as f:
            yield from pq.ParquetFile(f).iter_batches(READ_ROWS)


def frames(batches, more: tuple[str, ...] = ()):
    """(gallery_id, saved row or None, rows of one frame) of ordered Arrow batches; a row is (camera, frame, event, vector, conf, t, *more)."""
    now, held = None, []
    names = ("gallery_id", "camera_id", "frame_id", "event_id", "conf", "t", *more)
    for batch in batches:
        kinds = batch.column("saved").to_pylist()
        saved = batch.column("held").to_pylist() if 0 in kinds else None
        new = batch.filter(batch.column("saved").cast("bool")) if 0 in kinds else batch
        lists = [str(new.column(c).type).startswith("list") for c in names]  # of one length
        rows = zip(zip(*(matrix(new.column(c)) if x else new.column(c).to_pylist() for c, x in zip(names, lists))), matrix(new.column("embedding")))
        for k, kind in enumerate(kinds):
            if kind == 0:
                if held:
                    yield now[0], None, held
                now, held = None, []
                yield saved[k]["gallery_id"], saved[k], None
                continue
            (who, camera, frame, event, *more), v = next(rows)
            if (who, frame, camera) != now and held:
                yield now[0], None, held
                held = []
            now = (who, frame, camera)
            held.append((camera, frame, event, v, *more))
    if held:
        yield now[0], None, held


def walked(batches, settings: Settings):
    """(gallery_id, gallery, rows, results) after every frame; at a gallery's end rows is None."""
    now, gallery = None, None
    for who, saved, rows in frames(batches):
        if gallery is None or who != now:
            if gallery is not None:
                yield now, gallery, None, None
            now, gallery = who, Gallery(settings)
        if saved is not None:
            gallery.take(saved)
        else:
            yield who, gallery, rows, gallery.frame([(v, conf, t, frame) for _, frame, _, v, conf, t, *_ in rows])
    if gallery is not None:
        yield now, gallery, None, None


def arrow(rows: list, schema: str):
    """Record batches of tuples; none without rows."""
    import pyarrow as pa

    vector = pa.list_(pa.float64())
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": vector, "array<array<double>>": pa.list_(vector)}
    fields = [c.split() for c in schema.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def assigned_rows(who, rows: list, results: list) -> list[tuple]:
    return [(who, camera, frame, event, *result) for (camera, frame, event, *_), result in zip(rows, results)]


def folded(found: DataFrame, schema: str, of_frame, of_end, settings: Settings, start: DataFrame | None) -> DataFrame:
    """Rows that ``of_frame(who, gallery, rows, results)`` and, when a gallery ends, ``of_end(who, gallery)`` make."""

    path, tasks = runs(found, start)

    def run(batches):
        out = []
        for task in (tasks[i] for batch in batches for i in batch.column("id").to_pylist()):
            for who, g, rows, results in walked(read_runs(path, task), settings):
                out += of_end(who, g) if rows is None else of_frame(who, g, rows, results)
                if len(out) >= 5000:
                    yield from arrow(out, schema)
                    out = []
        yield from arrow(out, schema)

    return found.sparkSession.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, schema)


def none_of(*_) -> list:
    return []


def assign(found: DataFrame, settings: Settings = Settings(), start: DataFrame | None = None) -> DataFrame:
    """Track, decision, score and admission of every detection; galleries begin with those of ``start`` (``SAVED``) where it is given."""
    return folded(found, ASSIGNED, lambda who, g, rows, results: assigned_rows(who, rows, results), none_of, settings, start)


def saved_galleries(found: DataFrame, settings: Settings = Settings(), start: DataFrame | None = None) -> DataFrame:
    """Each gallery after its last frame as rows of ``SAVED``, from which a fold goes on as if it had not stopped."""
    return folded(found, SAVED, none_of, lambda who, g: g.saved(who), settings, start)


def final_galleries(found: DataFrame, settings: Settings = Settings(), start: DataFrame | None = None) -> DataFrame:
    """The entities left in each gallery after the last frame."""
    return snapshot_of(saved_galleries(found, settings, start))


def snapshot_of(saved: DataFrame) -> DataFrame:
    """Entities of ``SAVED`` as a snapshot shows them; absence is counted in prunes."""
    prunes = saved.where("entity_id is null").select(F.col("gallery_id").alias("_g"), F.col("prunes").alias("_p"))  # a row for each gallery
    rows = saved.where("entity_id is not null").join(prunes, F.col("gallery_id").eqNullSafe(F.col("_g")))
    shown = {"frames_since_seen": (F.col("_p") - F.col("seen_prune")).cast("int"), "buffer_size": F.size("buffer")}
    return rows.select(*[shown[n].alias(n) if n in shown else F.col(n) for n in names_of(SNAPSHOT)])


def counters_of(saved: DataFrame) -> DataFrame:
    """The counters of ``SAVED``, a row for each gallery."""
    return saved.where("entity_id is null").select("gallery_id", *names_of(COUNTERS))


HISTORY = "gallery_id long, first long, n int, gallery_size int"


def history(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(gallery_id, tick, gallery_size) at every 30th tick, those of frames without detections too."""

    def of(who, g, *_):
        sizes, g.sizes = g.sizes, []
        return [(who, *x) for x in sizes]

    runs = folded(found, HISTORY, of, of, settings, None)
    ticks = F.sequence(F.col("first"), F.col("first") + (F.col("n") - 1) * SAMPLE_EVERY, F.lit(SAMPLE_EVERY).cast("long"))
    return runs.select("gallery_id", F.explode(ticks).alias("tick"), "gallery_size")


STATISTICS = "gallery_id long, gallery_size int, max_size int, utilization double, total_added int, total_pruned int, match_decisions int, uncertain_decisions int, new_decisions int, current_ttl int, avg_confidence double, max_confidence double, min_confidence double, avg_appearances double, max_appearances int"


def statistics(found: DataFrame, settings: Settings = Settings(), start: DataFrame | None = None) -> DataFrame:
    """Counters and entity statistics of each gallery after the last frame; an empty gallery has no extremes."""

    def of(who, g):
        conf, seen = [e.average for e in g.entities.values()], [e.count for e in g.entities.values()]
        own = (float(np.mean(conf)), max(conf), min(conf), float(np.mean(seen)), max(seen)) if conf else (0.0, None, None, 0.0, None)
        return [(who, len(conf), settings.max_size, len(conf) / settings.max_size, g.added, g.pruned, *g.decisions.values(), g.ttl, *own)]

    return folded(found, STATISTICS, none_of, of, settings, start)


def restored(snapshot: DataFrame) -> DataFrame:
    """A saved gallery as it is loaded: one buffered observation, and counters of absence and averages at their defaults."""
    return snapshot.select("gallery_id", "entity_id", "ins_seq", "centroid", "confidence", "first_seen", "last_seen", F.lit(0).cast("long").alias("last_frame_id"), F.lit(0).alias("frames_since_seen"), "appearance_count", F.lit(0.0).alias("avg_confidence"), F.lit(0.0).alias("max_confidence"), F.lit(1).alias("buffer_size"))


def loaded(snapshot: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """A snapshot and, where they were saved, counters as rows of ``SAVED`` for a gallery that loads them.

    Entities are taken as ``restored`` says. The next id, the tick and the
    counters are those saved; without them the next id follows the largest.
    """
    given = dict(c.split() for c in SAVED.split(", "))
    filled = lambda df, **own: df.select(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in given.items()])
    new = restored(snapshot)
    if counters is None:
        counters = new.groupBy("gallery_id").agg((F.max("entity_id") + 1).alias("next_id"))
    zero = F.lit(0)
    rest = {n: F.coalesce(F.col(n), zero) if n in counters.columns else zero for n in names_of(COUNTERS) if n not in ("current_ttl", "newest_frame")}
    rest |= {n: F.col(n) if n in counters.columns else F.lit(None) for n in ("newest_frame",)}
    ttl = F.lit(Settings.ttl_sparse)
    prunes = counters.select(F.col("gallery_id").alias("_g"), rest["prunes"].alias("_p"))
    rows = new.join(prunes, F.col("gallery_id").eqNullSafe(F.col("_g")), "left")
    own = {n: F.col(n) for n in names_of(SNAPSHOT) if n in given}
    rows = filled(rows, **own, seen_prune=F.coalesce("_p", zero), buffer=F.array("centroid"), buffer_confidence=F.array("confidence"))
    return filled(counters, gallery_id=F.col("gallery_id"), **rest, current_ttl=ttl).unionByName(rows)


def merged(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``current`` galleries after loading a snapshot: saved entities replace those of their ids in place, others are added after all."""
    new = restored(snapshot)
    last = current.groupBy("gallery_id").agg(F.max("ins_seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy("gallery_id").orderBy("ins_seq"))  # a row per saved entity of one gallery
    known = current.select("gallery_id", "entity_id", F.col("ins_seq").alias("_at"))
    new = new.withColumn("_place", place).join(known, ["gallery_id", "entity_id"], "left").join(last, "gallery_id", "left")
    new = new.withColumn("ins_seq", F.coalesce("_at", F.coalesce("_last", F.lit(-1)) + F.col("_place"))).select(*current.columns)
    return current.join(new.select("gallery_id", "entity_id"), ["gallery_id", "entity_id"], "left_anti").select(*current.columns).unionByName(new)
