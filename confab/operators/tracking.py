"""Face tracking: assignment, motion filter, two-stage association and identities, one session's frames in order.

The cores are plain classes that take one frame at a time, so batch folds and
streaming state use the same code; a frame without detections changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators import vectors
from confab.session import cut

MOST_PROFILES = 32 << 20  # bytes of known vectors that go to every task at once; more are compared in blocks


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    row_pay, col_pay = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for row in range(n):
        reach, via = cost[row] - row_pay[row] - col_pay, np.full(n, -1)
        done, at, column = np.zeros(n, bool), row, -1
        visited_rows, seen = [row], []
        low = 0.0
        while True:
            open_ = np.where(done, np.inf, reach)
            column = int(open_.argmin())
            low = open_[column]
            done[column] = True
            seen.append(column)
            if owner[column] < 0:
                break
            at = owner[column]
            visited_rows.append(at)
            through = low + cost[at] - row_pay[at] - col_pay
            better = ~done & (through < reach)
            reach = np.where(better, through, reach)
            via[better] = column
        for r, c in zip(visited_rows[1:], seen[:-1]):
            row_pay[r] += low - reach[c]
        row_pay[row] += low
        for c in seen[:-1]:
            col_pay[c] -= low - reach[c]
        while via[column] >= 0:
            owner[column] = owner[via[column]]
            column = via[column]
        owner[column] = row
    out = np.empty(n, int)
    out[owner] = np.arange(n)
    return out


def match_pairs(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(pairs, rows left, columns left): the one-to-one matching whose pairs save most against the limit.

    A pair saves what its cost lies below the limit, staying alone saves nothing.
    """
    rows, cols = cost.shape
    saved = np.zeros((max(rows, cols),) * 2)
    saved[:rows, :cols] = np.maximum(limit - cost, 0)
    partner = hungarian(-saved)[:rows] if rows and cols else np.full(rows, cols)
    pairs = [(i, int(j)) for i, j in enumerate(partner) if saved[i, j] > 0] if rows and cols else []
    return pairs, sorted(set(range(rows)) - {i for i, _ in pairs}), sorted(set(range(cols)) - {j for _, j in pairs})


def box_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all pairs of boxes (x1, y1, x2, y2)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    w = np.maximum(0, np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]))
    h = np.maximum(0, np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return w * h / (area(a)[:, None] + area(b)[None, :] - w * h)


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float = 0.45) -> list[int]:
    """Boxes that no better kept box overlaps by more than the limit, best first."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        if not kept or np.nan_to_num(box_overlap(boxes[[i]], boxes[kept])).max() <= limit:
            kept.append(int(i))
    return kept


class Motion:
    """Constant-velocity filter of a box's centre, aspect and height."""

    position, velocity = 1 / 20, 1 / 160
    step = np.eye(8) + np.eye(8, k=4)

    def __init__(self, seen: np.ndarray):
        h = seen[3]
        self.mean = np.concatenate([seen, np.zeros(4)])
        spread = np.array([2 * self.position * h, 2 * self.position * h, 1e-2, 2 * self.position * h, 10 * self.velocity * h, 10 * self.velocity * h, 1e-5, 10 * self.velocity * h])
        self.cov = np.diag(spread**2)

    def predict(self, lost: bool) -> None:
        if lost:
            self.mean[7] = 0.0
        h = self.mean[3]
        noise = np.array([self.position * h, self.position * h, 1e-2, self.position * h, self.velocity * h, self.velocity * h, 1e-5, self.velocity * h])
        self.mean = self.step @ self.mean
        self.cov = self.step @ self.cov @ self.step.T + np.diag(noise**2)

    def correct(self, seen: np.ndarray) -> None:
        h = self.mean[3]
        s = self.cov[:4, :4] + np.diag(np.array([self.position * h, self.position * h, 1e-1, self.position * h]) ** 2)
        gain = np.linalg.solve(s, self.cov[:4, :]).T
        self.mean = self.mean + gain @ (seen - self.mean[:4])
        self.cov = self.cov - gain @ s @ gain.T

    def box(self) -> np.ndarray:
        x, y, aspect, h = self.mean[:4]
        return np.array([x - aspect * h / 2, y - h / 2, x + aspect * h / 2, y + h / 2])


def _measured(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, w / h, h])


@dataclass(eq=False)
class Track:
    id: int
    motion: Motion
    confidence: float
    detection: int
    began: int
    seen: int
    confirmed: bool
    lost: bool = False


@dataclass
class FaceTracker:
    """Two-stage association: sure detections first, then faint ones for tracks still alive; new tracks need a second sight."""

    faint: float = 0.1
    sure: float = 0.45
    buffer: int = 150
    frame: int = 0
    last_id: int = 0
    tracks: list[Track] = field(default_factory=list)

    def take(self, boxes: np.ndarray, confidence: np.ndarray) -> list[Track]:
        """Confirmed tracks after a frame's detections."""
        if not len(boxes):
            return []
        boxes, confidence = boxes.astype(np.float32).astype(float), confidence.astype(np.float32).astype(float)
        self.frame += 1
        high, low = np.flatnonzero(confidence > self.sure), np.flatnonzero((confidence > self.faint) & (confidence < self.sure))
        pool, fresh = [t for t in self.tracks if t.confirmed], [t for t in self.tracks if not t.confirmed]
        pool = [t for t in pool if not t.lost] + [t for t in pool if t.lost]
        for t in pool:
            t.motion.predict(t.lost)
        pairs, alone, left = match_pairs(self._cost(pool, boxes[high], confidence[high]), 0.8)
        for i, j in pairs:
            self._see(pool[i], boxes, confidence, high[j])
        rest = [pool[i] for i in alone if not pool[i].lost]
        pairs, unseen, _ = match_pairs(self._cost(rest, boxes[low], None), 0.5)
        for i, j in pairs:
            self._see(rest[i], boxes, confidence, low[j])
        for i in unseen:
            rest[i].lost = True
        high = high[left]
        pairs, unseen, left = match_pairs(self._cost(fresh, boxes[high], confidence[high]), 0.7)
        for i, j in pairs:
            self._see(fresh[i], boxes, confidence, high[j])
        gone = {id(fresh[i]) for i in unseen}
        for j in left:
            d = high[j]
            if confidence[d] >= self.sure:
                self.last_id += 1
                self.tracks.append(Track(self.last_id, Motion(_measured(boxes[d])), confidence[d], int(d), self.frame, self.frame, self.frame == 1))
        self.tracks = [t for t in self.tracks if id(t) not in gone and not (t.lost and self.frame - t.seen > self.buffer)]
        self._drop_doubles()
        return [t for t in self.tracks if t.confirmed and not t.lost]

    def _cost(self, tracks: list[Track], boxes: np.ndarray, confidence: np.ndarray | None) -> np.ndarray:
        cost = 1 - box_overlap(np.array([t.motion.box() for t in tracks]).reshape(-1, 4), boxes)
        return cost if confidence is None or not cost.size else 1 - (1 - cost) * confidence[None, :]

    def _see(self, track: Track, boxes: np.ndarray, confidence: np.ndarray, d: int) -> None:
        track.motion.correct(_measured(boxes[d]))
        track.confidence, track.detection, track.seen, track.confirmed, track.lost = float(confidence[d]), int(d), self.frame, True, False

    def _drop_doubles(self) -> None:
        """Of an alive and a lost track on one place the longer-lived stays; the lost one where they are equal."""
        live, lost = [t for t in self.tracks if not t.lost], [t for t in self.tracks if t.lost]
        near = box_overlap(np.array([t.motion.box() for t in live]).reshape(-1, 4), np.array([t.motion.box() for t in lost]).reshape(-1, 4)) > 0.85
        gone = set()
        for i, j in zip(*np.nonzero(near)):
            longer = live[i].seen - live[i].began > lost[j].seen - lost[j].began
            gone.add(id(lost[j]) if longer else id(live[i]))
        self.tracks = [t for t in self.tracks if id(t) not in gone]


@dataclass
class FaceNamer:
    """Names of tracks by face vectors: five agreeing frames confirm a name, no name is on two faces, strangers enrol."""

    known: dict[str, np.ndarray] = field(default_factory=dict)
    match: float = 0.65
    merge: float = 0.55
    confirm: int = 5
    enrol_at: int = 40
    enrol_by: int = 120
    spread: float = 0.05
    names: dict[int, str] = field(default_factory=dict)
    votes: dict[int, tuple[str, int, float]] = field(default_factory=dict)
    buffers: dict[int, list[np.ndarray]] = field(default_factory=dict)
    fails: dict[int, int] = field(default_factory=dict)
    seen: dict[int, float] = field(default_factory=dict)
    strangers: int = 0
    listed: dict[bool, tuple[list[str], np.ndarray]] = field(default_factory=dict)
    first: int = 0

    def __post_init__(self):
        self.first = len(self.known)

    @staticmethod
    def generic(name: str) -> bool:
        return name == "Unknown" or name.startswith("Person_") and name[7:].isdigit()

    def take(self, at: float, faces: dict[int, np.ndarray], nearest: dict[int, tuple[str, float]] | None = None) -> dict[int, tuple[str, float]]:
        """(name, score) of each track of a frame; ``nearest``: the best first profile of a track, from ``match``, where they were compared before."""
        claimed = {}
        for t, name in self.names.items():
            if not self.generic(name) and (t in faces or at - self.seen.get(t, 0.0) < (30.0 if name in self.known else 5.0)):
                claimed[name] = t
        out = {}
        for t, v in faces.items():
            self.seen[t] = at
            name, score = self._best(v, None if nearest is None else nearest.get(t, (None, -1.0)))
            if name is not None:
                name = self._confirmed(t, name, score, v, claimed)
            if name is None and t in self.names:
                name, score = self._persisted(t, v, claimed)
            if name is None:
                name, score = self._enrolled(t, v, at, claimed) or (None, score)
            out[t] = (name or "Unknown", score if name else 0.0)
        return out

    def _best(self, v: np.ndarray, given: tuple[str | None, float] | None) -> tuple[str | None, float]:
        best, score = self._nearest(v) if given is None else self._nearer(given, v)
        return (best if score >= self.match else None), score

    def _nearest(self, v: np.ndarray) -> tuple[str | None, float]:
        """The known name nearest to a vector, the first of equals; profiles are only ever added."""
        return self._nearer(self._among(False, v), v)

    def _nearer(self, given: tuple[str | None, float], v: np.ndarray) -> tuple[str | None, float]:
        stranger = self._among(True, v)
        return stranger if stranger[1] > given[1] else given

    def _among(self, strangers: bool, v: np.ndarray) -> tuple[str | None, float]:
        """The nearest of the first profiles, or of those added since."""
        n = len(self.known) - self.first if strangers else self.first
        if not n:
            return None, -1.0
        names, rows = self.listed.get(strangers, ([], None))
        if len(names) != n:
            names = list(self.known)[self.first :] if strangers else list(self.known)[: self.first]
            rows = np.stack([self.known[name] for name in names])
            self.listed[strangers] = names, rows
        likeness = np.round(rows @ v, 12)
        best = int(likeness.argmax())
        return names[best], float(likeness[best])

    def _confirmed(self, t: int, name: str, score: float, v: np.ndarray, claimed: dict[str, int]) -> str | None:
        if claimed.get(name, t) != t:
            return None
        current = self.names.get(t)
        if current == name:
            self._settle(t, name, claimed)
            return name
        if current in self.known and float(v @ self.known[current]) >= 0.20:
            held = float(v @ self.known[current])
            stronger = score >= 0.75 and held < 0.35 or self.generic(current) and not self.generic(name) and held < 0.45
            if not stronger:
                return None
            del self.names[t]
        if not self.generic(name) and any(o != t and n == name and mean > score for o, (n, _, mean) in self.votes.items()):
            return None
        old = self.votes.get(t)
        count, mean = (old[1] + 1, old[2]) if old and old[0] == name else (1, 0.0)
        mean = (mean * (count - 1) + score) / count
        self.votes[t] = (name, count, mean)
        if count < self.confirm:
            return None
        self.votes = {o: x for o, x in self.votes.items() if x[0] != name}
        self._settle(t, name, claimed)
        return name

    def _settle(self, t: int, name: str, claimed: dict[str, int]) -> None:
        claimed[name] = t
        self.names[t] = name
        for state in (self.buffers, self.fails, self.votes):
            state.pop(t, None)

    def _persisted(self, t: int, v: np.ndarray, claimed: dict[str, int]) -> tuple[str | None, float]:
        name = self.names[t]
        if name in self.known and float(v @ self.known[name]) < 0.20:
            self.fails[t] = self.fails.get(t, 0) + 1
            if self.fails[t] >= 3:
                for state in (self.names, self.fails, self.votes):
                    state.pop(t, None)
                return None, 0.0
        else:
            self.fails.pop(t, None)
        if claimed.get(name, t) != t:
            return None, 0.0
        claimed[name] = t
        return name, 1.0

    def _enrolled(self, t: int, v: np.ndarray, at: float, claimed: dict[str, int]) -> tuple[str, float] | None:
        held = self.buffers.setdefault(t, [])
        held.append(v)
        n = len(held)
        if n < self.enrol_at:
            return None
        total = np.sum(held, axis=0)
        diverse = 1 - (total @ total - sum(float(x @ x) for x in held)) / (n * (n - 1))
        if diverse < self.spread and n < self.enrol_by:
            return None
        mean = total / n
        mean = mean / (np.linalg.norm(mean) + 1e-8)
        live = {name for o, name in self.names.items() if o != t and at - self.seen.get(o, 0.0) < 2.0}
        best, score = self._nearest(mean)
        if best is None or score < self.merge or best in live:
            self.strangers += 1
            best = f"Person_{self.strangers}"
            self.known[best] = mean
        self.names[t] = best
        del self.buffers[t]
        claimed[best] = t
        return best, 1.0


@dataclass
class FaceAsker(FaceNamer):
    """A FaceNamer that holds only some of the profiles: the nearest of all to an enrolment's mean is answered, or else guessed and asked."""

    answers: dict[int, tuple[str | None, float]] = field(default_factory=dict)
    asked: list[tuple[int, np.ndarray, str | None]] = field(default_factory=list)
    means: int = 0

    def _nearest(self, v: np.ndarray) -> tuple[str | None, float]:
        n, self.means = self.means, self.means + 1
        if n in self.answers:
            return self._nearer(self.answers[n], v)
        guess = self._among(False, v)
        guess = guess if guess[1] >= self.merge else (None, -1.0)
        self.asked.append((n, v, guess[0]))
        return self._nearer(guess, v)


def _unit_faces(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)


def _named(namer: FaceNamer, part: pd.DataFrame, rows: np.ndarray, nearest: dict[int, tuple[str, float]]) -> list[tuple]:
    """(frame, track, name, score) of one session's faces; unit vectors and nearest first profiles by the number in ``row``."""
    out = []
    for (frame, at), shown in part.sort_values(["frame", "track"]).groupby(["frame", "at"], sort=True):
        where = {int(t): (i, int(r)) for t, i, r in zip(shown["track"], shown["place"], shown["row"])}
        named = namer.take(float(at), {t: rows[i] for t, (i, _) in where.items()}, {t: nearest[r] for t, (_, r) in where.items() if r in nearest})
        out += [(frame, t, n, float(s)) for t, (n, s) in named.items()]
    return out


def name_faces(faces: DataFrame, known: DataFrame, session: str) -> DataFrame:
    """(session, frame, track, name, score) of face vectors (session, frame, at, track, embedding) by FaceNamer; a session is one recording.

    ``known`` (name, centroid) holds the profiles.  Up to MOST_PROFILES bytes of
    them go to every task; however many there are beyond, all are compared.
    """
    known = known.filter(F.col("name").isNotNull()).select("name", F.col("centroid").cast("array<double>").alias("centroid")).persist()
    size = known.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0)) * 8).first()[0]
    faces = faces.select(session, "frame", "at", "track", "embedding")
    if size > MOST_PROFILES:
        named = _named_by_blocks(faces, known, session)
        known.unpersist()
        return named
    table = known.orderBy("name").toArrow()
    known.unpersist()
    column = table.column("centroid").combine_chunks()
    rows = column.values.to_numpy(zero_copy_only=False).reshape(max(table.num_rows, 1), -1)[: table.num_rows]
    profiles = faces.sparkSession.sparkContext.broadcast((table.column("name").to_pylist(), vectors.unit_rows(rows)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, held = profiles.value
        namer, own = FaceNamer(known=dict(zip(names, held))), _unit_faces(np.stack(part["embedding"]).astype(np.float64))
        part = part.drop(columns="embedding").assign(row=range(len(part)), place=range(len(part)))
        nearest = {i: (names[j], s) for i, j, s in zip(*(x.tolist() for x in vectors.nearest_rows(own, held, namer.match)))}
        return pd.DataFrame([(key[0], *x) for x in _named(namer, part, own, nearest)], columns=[session, "frame", "track", "name", "score"])

    return faces.groupBy(session).applyInPandas(run, f"`{session}` {faces.schema[session].dataType.simpleString()}, frame bigint, track bigint, name string, score double")


def _named_by_blocks(faces: DataFrame, known: DataFrame, session: str) -> DataFrame:
    """name_faces() where no task holds all profiles.

    The nearest profile of each face is found by blocks.  A session then gets
    the profiles that can name its tracks: a name needs ``confirm`` faces of one
    track that are nearest to it.  The other way to a name is the mean of an
    enrolment; which profile is nearest to it is guessed among those that the
    session has, and all guesses are then held against all profiles.  Sessions
    with a wrong guess are gone through again with the answers up to it, so
    every round settles one more at least, and no guess is in the result.
    """
    kind = faces.schema[session].dataType.simpleString()
    faces = cut(faces).withColumn("row", F.monotonically_increasing_id())
    found = cut(vectors.nearest(faces, known, [session, "track", "row"], "name", "embedding", FaceNamer.match, _unit_faces))
    needed = found.groupBy(session, "track", "name").count().filter(F.col("count") >= FaceNamer.confirm).select(session, "name")
    fields = {"row": "bigint", "n": "int", "name": "string", "score": "double", "centroid": "array<double>"}
    told = lambda df: df.select(session, *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
    answers = told(found.limit(0))

    def run(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = [session, "frame", "track", "name", "score", "n", "mean"]
        if part.empty:
            return pd.DataFrame([], columns=columns)
        own = _unit_faces(np.stack(part["embedding"]).astype(np.float64))
        nearest = {int(r): (n, s) for r, n, s in told.loc[told["row"].notna(), ["row", "name", "score"]].itertuples(index=False)}
        answers = {int(n): (name, s) if isinstance(name, str) else (None, -1.0) for n, name, s in told.loc[told["n"].notna(), ["n", "name", "score"]].itertuples(index=False)}
        held = told.loc[told["centroid"].notna(), ["name", "centroid"]].sort_values("name")
        namer = FaceAsker(known=dict(zip(held["name"], vectors.unit_rows(np.stack(held["centroid"])) if len(held) else ())), answers=answers)
        named = _named(namer, part.drop(columns="embedding").assign(place=range(len(part))), own, nearest)
        return pd.DataFrame([(key[0], *x, None, None) for x in named] + [(key[0], None, None, guess, None, n, mean) for n, mean, guess in namer.asked], columns=columns).astype({"frame": "Int64", "track": "Int64", "n": "Int32"})

    done = []
    while True:
        profiles = needed.union(answers.filter("name is not null").select(session, "name")).distinct().join(known, "name")
        out = faces.groupBy(session).cogroup(told(found).union(told(profiles)).union(answers).groupBy(session)).applyInPandas(run, f"`{session}` {kind}, frame bigint, track bigint, name string, score double, n int, mean array<double>")
        out = cut(out)
        done.append(out.filter("n is null").select(session, "frame", "track", "name", "score"))
        asked = out.filter("n is not null").select(session, "n", "mean", F.col("name").alias("guess"))
        if asked.isEmpty():
            break
        best = vectors.nearest(asked, known, [session, "n"], "name", "mean", FaceNamer.merge, np.asarray)
        both = asked.select(session, "n", "guess", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score")).union(best.select(session, "n", F.lit(None).cast("string"), "name", "score"))
        told_now = cut(both.groupBy(session, "n").agg(*(F.max(c).alias(c) for c in ("guess", "name", "score"))))
        wrong = cut(told_now.filter(~F.col("guess").eqNullSafe(F.col("name"))).groupBy(F.col(session).alias("_session")).agg(F.min("n").alias("_until")))
        if wrong.isEmpty():
            break
        again = lambda df, how: df.join(wrong, df[session].eqNullSafe(wrong["_session"]), how)
        done[-1] = again(done[-1], "left_anti")
        faces = again(faces, "left_semi")
        answers = cut(again(answers, "left_semi").union(told(again(told_now, "inner").filter("n <= _until"))))
    return reduce(DataFrame.union, done)


def track_faces(detections: DataFrame, session: str) -> DataFrame:
    """Tracks of each session's detections (session, frame, det, x1, y1, x2, y2, confidence); a session is one recording."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tracker, out = FaceTracker(), []
        for frame, rows in part.sort_values(["frame", "det"]).groupby("frame", sort=True):
            for t in tracker.take(rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["confidence"].to_numpy(float)):
                out.append((key[0], frame, t.id, *t.motion.box(), t.confidence))
        return pd.DataFrame(out, columns=[session, "frame", "track", "x1", "y1", "x2", "y2", "confidence"])

    return detections.groupBy(session).applyInPandas(run, f"{session} bigint, frame bigint, track bigint, x1 double, y1 double, x2 double, y2 double, confidence double")


def best_boxes(detections: DataFrame, frame: str, limit: float = 0.45) -> DataFrame:
    """(frame, det) of the detections that suppression keeps."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("det")
        kept = suppress(part[["x1", "y1", "x2", "y2"]].to_numpy(float), part["confidence"].to_numpy(float), limit)
        return pd.DataFrame({frame: key[0], "det": part["det"].to_numpy()[kept]})

    return detections.groupBy(frame).applyInPandas(run, f"{frame} bigint, det bigint")
