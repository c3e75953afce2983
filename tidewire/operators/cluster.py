"""Events: stories are taken in order of weight, and each joins the event it fits best or opens one.

To join, a story must be similar to one member, near to all members and free of conflict with what the event is about.
An event therefore lies within one connected group of similar stories; groups are found first, and the ordered pass runs
in each group on its own. Stories with the same features are one class: classes are compared, not stories, and an event is known by how many stories of each class it has. So a story that is told a thousand times costs a
thousand rows, and no table of pairs is made.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import event_id
from tidewire.operators.graph import components, cut, forget, spread_join
from tidewire.operators.similarity import NO_CELL, StoryClasses, class_cells, class_pairs, near_cells, story_classes, with_features_once


def processing_order() -> list[Column]:
    """Official first, then priority, then the latest, then the largest id."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    official = flag("is_official") | (F.coalesce("source_type", F.lit("")) == "official") | flag("is_primary_source")
    weight = F.coalesce(F.nullif("priority_score", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0))
    uid = F.coalesce(F.nullif("article_id", F.lit("")), F.col("url"), F.lit(""))
    return [official.cast("int").desc(), weight.desc(), F.col("published_at").desc_nulls_last(), uid.desc()]


def with_position(df: DataFrame) -> DataFrame:
    """Add ``pos``: the row's place in the processing order, a total order over an issue's stories."""
    return numbered(df, processing_order(), "pos")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add each row's place, from 0, in a total order. Rows are sorted by range and numbered by the sizes of the ranges
    before, so that no task sees all rows."""
    ranged = cut(df.repartitionByRange(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are ranges
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_local", local).join(before, "_range").withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_range", "_local", "_before")


@dataclass(frozen=True)
class Traits:
    """What a class of stories says, or what all stories of an event say together."""

    models: frozenset = frozenset()
    entities: frozenset = frozenset()
    themes: frozenset = frozenset()
    actions: frozenset = frozenset()
    anchors: frozenset = frozenset()

    def __or__(self, other: Traits) -> Traits:
        return Traits(*(getattr(self, f) | getattr(other, f) for f in _TRAITS))


_TRAITS = ("models", "entities", "themes", "actions", "anchors")


def _concrete(anchors: frozenset, action: str | None = None) -> set:
    return {(e, m) for a, e, m in anchors if e and m and (action is None or a == action)}


def _allowed(mine: str, theirs: str, f: Traits, ev: Traits) -> bool:
    """Whether a conflicting pair of actions can belong to one event after all."""
    pair, model_tie = {mine, theirs}, bool(_concrete(f.anchors) & _concrete(ev.anchors))
    several, themes = len(f.entities & ev.entities) >= 2, f.themes & ev.themes
    mine_released = "release" in f.actions
    both_released = mine_released and "release" in ev.actions
    moves = {"office_expansion", "executive_movement"}
    if pair & moves:
        return model_tie and (mine_released if mine in moves else both_released)
    if pair == {"investment", "legal"}:
        return False
    if pair == {"partnership", "legal"}:
        return several and bool(themes & {"legal_policy", "partnership"})
    topic = "legal" if "legal" in pair else "security"  # against a release
    if model_tie and mine_released and (mine == topic or both_released or topic == "legal" and "legal" in f.actions):
        return True
    if topic == "legal":
        return several and "legal_policy" in themes
    return bool(themes & {"security_safety", "partnership"}) and (model_tie or several)


def agrees(f: Traits, ev: Traits) -> bool:
    """Whether a story may join an event by what both are about."""
    if ("pricing" in f.actions and "release" in ev.actions) or ("release" in f.actions and "pricing" in ev.actions):
        launched = _concrete(f.anchors, "release") & _concrete(ev.anchors, "pricing") | _concrete(f.anchors, "pricing") & _concrete(ev.anchors, "release")
        if not launched:
            return False
    if f.models and ev.models and not f.models & ev.models:
        shared = f.themes & ev.themes & {"partnership", "security_safety", "legal_policy", "benchmarking"} or f.actions & ev.actions & {"partnership", "security", "legal"}
        if not (shared or len(f.entities & ev.entities) >= 2):
            return False
    return all(_allowed(mine, theirs, f, ev) for x, y in rules.CONFLICTS for mine, theirs in ((x, y), (y, x)) if mine in f.actions and theirs in ev.actions)


@dataclass
class _Event:
    """An event as the pass knows it: how many stories of which class, and their first and last time."""

    first: int
    about: int  # what it is about, by number
    at: tuple[int, int]  # cell and class of the first story
    n: int = 0
    lo: int | None = None
    hi: int | None = None
    counts: dict[tuple[int, tuple], list] = field(default_factory=dict)  # class and shared identities: [number, first, last time]


def _wider(lo: int | None, hi: int | None, at: int | None) -> tuple[int | None, int | None]:
    return (lo, hi) if at is None else (at if lo is None else min(lo, at), at if hi is None else max(hi, at))


class OrderedPass:
    """One pass over the stories of a group in order. It holds classes, their similarities and events; not stories."""

    def __init__(self, tie: float, near: float, window_hours: float):
        self.tie, self.near, self.hours = tie, near, window_hours
        self.traits: dict[int, Traits] = {}
        self.like: dict[int, dict[int, float]] = {}
        self.events: list[_Event] = []
        # Who joins is near to all, so to the first: a cell's events as they open, and again as what they are about changes,
        # with what they are about.
        self.opened: dict[int, tuple[array, array]] = {}
        # Of a class and cell: how much of that list was looked at, and the events that a story may still fit.
        self.fits: dict[tuple[int, int], tuple[int, set[int]]] = {}
        self.named: dict[str, set[int]] = {}  # identity: the events that have it
        self.numbers: dict[Traits, int] = {}
        self.subjects: list[Traits] = []
        self.kinds: dict[Traits, int] = {}
        self.kind: dict[int, int] = {}  # a class: what it says but for its words, by number
        self.known: list[np.ndarray] = []  # of what is said and what events are about: 1 if they agree, 0 if not, -1 unasked
        self.values: dict = {}  # classes and similarities, each held once

    def learn(self, g: int, traits: Traits, like: dict[int, float]) -> None:
        one = self.values.setdefault
        self.traits[g], self.like[g] = traits, {one(h, h): one(x, x) for h, x in like.items()}
        self.kind[g] = self.kinds.setdefault(traits, len(self.kinds))
        if len(self.known) < len(self.kinds):
            self.known.append(np.full(64, -1, np.int8))

    def _far(self, at: int | None, lo: int | None, hi: int | None) -> bool:
        return at is not None and lo is not None and max(at - lo, hi - at) / 1e6 / 3600.0 > self.hours

    def _number(self, traits: Traits) -> int:
        """What events are about, numbered."""
        if traits not in self.numbers:
            self.numbers[traits] = len(self.subjects)
            self.subjects.append(traits)
        return self.numbers[traits]

    def _answers(self, g: int) -> np.ndarray:
        """What is known of what a class says, with room for all that events are about."""
        table = self.known[self.kind[g]]
        if len(table) < len(self.subjects):
            table = self.known[self.kind[g]] = np.concatenate([table, np.full(len(self.subjects), -1, np.int8)])
        return table

    def _agrees(self, g: int, about: int) -> bool:
        """Asked once for what a class says and what an event is about, however many such there are."""
        table = self._answers(g)
        if table[about] < 0:
            table[about] = agrees(self.traits[g], self.subjects[about])
        return bool(table[about])

    def _fitting(self, g: int, cell: int) -> set[int]:
        """Events of a cell whose first story may be near those of a class, and that nothing speaks against; some may not fit
        any more. An event is looked at once for a class, and again only when what it is about changes."""
        seen, fits = self.fits.get((g, cell), (0, set()))
        ks, abouts = self.opened.get(cell, ((), ()))
        if seen < len(ks):
            new, table = np.frombuffer(abouts, np.int64)[seen:], self._answers(g)
            for about in set(new[table[new] < 0].tolist()):
                self._agrees(g, about)
            like, events = self.like[g], self.events
            fits.update(k for k in (ks[seen + i] for i in np.flatnonzero(table[new]).tolist()) if events[k].at[1] in like)
            self.fits[g, cell] = (len(ks), fits)
        return fits

    def _never(self, g: int, event: _Event) -> bool:
        """Whether no story of a class fits an event any more, but for shared identities: classes stay in events."""
        like = self.like[g]
        return any(like.get(h, 0.0) < self.near for h, _ in event.counts)

    def _mean(self, g: int, at: int | None, same: tuple, event: _Event) -> float | None:
        """The mean similarity to an event's stories, each class counting as often as it is there; None if one of them is
        not near or none is similar."""
        if not same and self._far(at, event.lo, event.hi):
            return None
        like, names = self.like[g], set(same)
        best, parts = 0.0, []
        for (h, theirs), (n, lo, hi) in event.counts.items():
            if names and not names.isdisjoint(theirs):
                value = 1.0
            else:
                value = like.get(h, 0.0)
                if value < self.near or value <= 0.0 or names and self._far(at, lo, hi):
                    return None
            best = max(best, value)
            parts.append(n * value)
        return round(math.fsum(parts) / event.n, 12) if best >= self.tie else None

    def place(self, pos: int, g: int, at: int | None, cell: int, same: tuple) -> int:
        """The first story of the event that the story joins, or itself."""
        best, best_mean = None, -1.0
        means = {k: self._mean(g, at, same, self.events[k]) for name in same for k in self.named.get(name, ()) if self._agrees(g, self.events[k].about)}
        for c in list(self.opened) if cell == NO_CELL else (cell - 1, cell, cell + 1, NO_CELL):
            gone = []
            for k in (fits := self._fitting(g, c)):
                event = self.events[k]
                if not self._agrees(g, event.about):
                    gone.append(k)  # until what it is about changes again
                elif k not in means:
                    means[k] = self._mean(g, at, same, event)
                    if means[k] is None and self._never(g, event):
                        gone.append(k)
            fits.difference_update(gone)
        for k in sorted(means):
            if means[k] is not None and means[k] > best_mean:
                best, best_mean = k, means[k]
        if best is None:
            best = len(self.events)
            self.events.append(_Event(pos, self._number(self.traits[g]), (cell, g)))
            self._open(best)
        self._add(best, g, at, same)
        return self.events[best].first

    def _open(self, k: int) -> None:
        ks, abouts = self.opened.setdefault(self.events[k].at[0], (array("q"), array("q")))
        ks.append(k)
        abouts.append(self.events[k].about)

    def _add(self, k: int, g: int, at: int | None, same: tuple) -> None:
        event = self.events[k]
        about = self._number(self.subjects[event.about] | self.traits[g])
        if about != event.about:
            event.about = about
            self._open(k)
        for name in same:
            self.named.setdefault(name, set()).add(k)
        own = event.counts.setdefault((g, same), [0, None, None])
        own[0], (own[1], own[2]) = own[0] + 1, _wider(own[1], own[2], at)
        event.n, (event.lo, event.hi) = event.n + 1, _wider(event.lo, event.hi, at)


def _passes(tie: float, near: float, window_hours: float):
    """The pass over partitions in which each group's classes come first and then its stories in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["component"] != group:
                    group, state = r["component"], OrderedPass(tie, near, window_hours)
                if r["pos"] is None:
                    sets = [frozenset(r[f"f_{n}"]) for n in ("models", "entities", "themes", "effective")]
                    anchors = frozenset((x["action"], x["entity"], x["model"]) for x in r["f_anchors"])
                    state.learn(r["g"], Traits(*sets, anchors), {x["h"]: x["similarity"] for x in r["like"] or ()})
                else:
                    out.append((r["pos"], state.place(r["pos"], r["g"], r["at"], r["cell"], tuple(r["same"]))))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["pos", "event_pos"])

    return run


def story_groups(found: StoryClasses, pairs: DataFrame, window_hours: float) -> DataFrame:
    """(g, cell, component): stories of one class and cell of time, and the group of all that they may share an event with.

    Those of two similar classes are connected if they lie in one cell, or in neighbouring ones with ends near in time;
    shared ids and addresses connect them at any time."""
    nodes = class_cells(found)
    edges = near_cells(nodes, pairs, window_hours).select("u", "v")
    own = found.members.select("pos", "g", "cell", F.explode("same").alias("key")).join(nodes.select("g", "cell", "node"), ["g", "cell"])
    firsts = own.groupBy("key").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("m"))
    named = spread_join(own.select("key", F.col("node").alias("v")), firsts, ["key"], "m", found.members.count()).select("u", "v")
    tied = components(edges.unionByName(named))
    out = cut(nodes.join(tied.withColumnRenamed("id", "node"), "node", "left").select("g", "cell", "n", F.coalesce("component", "node").alias("component")))
    forget(nodes)
    return out


def assign_events(articles: DataFrame, similarity: float = rules.SIMILARITY, window_hours: float = rules.WINDOW_HOURS) -> DataFrame:
    """Articles (normalised, scored) with ``pos`` and ``event_pos``, the position of the event's first story, and
    ``member_pos``, the place within the event.

    Means are compared to 12 digits, so that the order in which similarities are added does not decide."""
    near = similarity * rules.COHESION
    placed = with_features_once(with_position(articles))
    found = story_classes(placed, window_hours=window_hours)
    pairs = class_pairs(found, near)
    groups = story_groups(found, pairs.filter(F.col("similarity") >= similarity), window_hours)
    several = groups.groupBy("component").agg(F.sum("n").alias("size")).filter("size > 1")
    groups = cut(groups.join(several.select("component"), "component"))
    told = F.struct(F.col("h"), F.col("similarity"))
    like = pairs.select("g", told.alias("like")).unionByName(pairs.filter("g != h").select(F.col("h").alias("g"), F.struct(F.col("g").alias("h"), "similarity").alias("like"))).groupBy("g").agg(F.collect_list("like").alias("like"))
    classes = found.classes.select("g", "f_models", "f_entities", "f_themes", "f_effective", "f_anchors").join(like, "g", "left").join(groups.select("component", "g").distinct(), "g")
    stories = spread_join(found.members, groups, ["g", "cell"], "n", placed.count())
    both = classes.unionByName(stories, allowMissingColumns=True)
    # Sorted within a partition, a group is read as a stream: classes first, as they have no place.
    ordered = both.repartition("component").sortWithinPartitions(F.col("component"), F.col("pos").asc_nulls_first())
    events = ordered.mapInArrow(_passes(similarity, near, window_hours), "pos long, event_pos long")
    out = cut(placed.join(events, "pos", "left").withColumn("event_pos", F.coalesce("event_pos", "pos")))
    return out.withColumn("member_pos", F.row_number().over(Window.partitionBy("event_pos").orderBy("pos")) - 1)


def primary_rank() -> list[Column]:
    """What an event shows first: official, then priority, then source score, then the earliest in order."""
    official = F.coalesce("is_official", F.lit(False)) | (F.coalesce("source_type", F.lit("")) == "official")
    weight = F.coalesce(F.nullif("priority_score", F.lit(0.0)), F.col("score"), F.lit(0.0))
    return [official.cast("int").desc(), weight.desc(), F.coalesce("source_score", F.lit(0.0)).desc(), F.col("pos").asc()]


def with_event_ids(assigned: DataFrame) -> DataFrame:
    """Add event_id, event_title and relationship with its constant similarity: 1.0 for the primary story, else 0.85."""
    first = F.row_number().over(Window.partitionBy("event_pos").orderBy(*primary_rank()))
    ranked = assigned.withColumn("_rank", first)
    heads = ranked.filter("_rank = 1").select("event_pos", event_id("url").alias("event_id"), F.col("title").alias("event_title"), F.col("article_id").alias("primary_article_id"))
    out = ranked.drop("_rank").join(heads, "event_pos")
    main = F.col("article_id") == F.col("primary_article_id")
    return out.withColumns({"relationship": F.when(main, "primary").otherwise("coverage"), "similarity": F.when(main, 1.0).otherwise(0.85)})
