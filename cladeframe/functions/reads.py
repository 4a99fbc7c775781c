"""Cleaning of a read's events, as Column expressions over arrays within a row: no shuffle, whatever the number of reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .events import parse_event

#: Cells of a target without an event.
NO_EVENT = ("NONE", "UNKNOWN")
EVENTS = "array<struct<start_pos:int,del_len:int,min_target:int,max_target:int,insert_str:string>>"


@dataclass(frozen=True)
class Design:
    """Cut sites and first and last bases of the windows of a barcode's targets, and its length."""

    cuts: tuple[int, ...]
    lo: tuple[int, ...]
    hi: tuple[int, ...]
    length: int

    @classmethod
    def of(cls, substrings: list[str], cut_site: int = 6, crucial: tuple[int, int] = (6, 6)) -> Design:
        """From spacer, target, spacer, ..., spacer: a cut stands cut_site bases before the end of its target."""
        ends = [sum(map(len, substrings[: 2 * k + 2])) for k in range((len(substrings) - 1) // 2)]
        length, cuts = sum(map(len, substrings)), tuple(e - cut_site for e in ends)
        return cls(cuts, tuple(max(0, c - crucial[0]) for c in cuts), tuple(min(length - 1, c + crucial[1] - 1) for c in cuts), length)

    def rows(self) -> list[tuple[int, ...]]:
        """target, cut, pos_lo, pos_hi, least long trims and greatest trims on both sides.  At the outer ends no trim is long, and the least long one equals the greatest."""
        n, c = len(self.cuts), self.cuts
        left = [c[0]] + [c[k] - c[k - 1] - 1 for k in range(1, n)]
        right = [c[k + 1] - c[k] - 1 for k in range(n - 1)] + [self.length - c[-1] - 1]
        long_left = [left[0]] + [c[k] - self.hi[k - 1] for k in range(1, n)]
        long_right = [self.lo[k + 1] - c[k] + 1 for k in range(n - 1)] + [right[-1]]
        return [(k, c[k], self.lo[k], self.hi[k], long_left[k], long_right[k], left[k], right[k]) for k in range(n)]


def _at(values: tuple[int, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def spans(cells: Column) -> Column:
    """array of (event, min_target, max_target, ord) of an array of target cells: events of a cell are joined by '&', one event stands in every target that it spans."""
    each = F.flatten(F.transform(cells, lambda c, t: F.transform(F.split(c, "&"), lambda e, k: F.struct(e.alias("event"), t.alias("target"), (t * 1000 + k).alias("ord")))))
    there = F.filter(each, lambda x: ~x["event"].isin(*NO_EVENT))

    def span(name: Column, mine: Column) -> Column:
        targets = F.transform(mine, lambda x: x["target"])
        return F.struct(name.alias("event"), F.array_min(targets).alias("min_target"), F.array_max(targets).alias("max_target"), F.array_min(F.transform(mine, lambda x: x["ord"])).alias("ord"))

    names = lambda all_: F.array_distinct(F.transform(all_, lambda x: x["event"]))
    return let(there, lambda all_: F.transform(names(all_), lambda n: let(F.filter(all_, lambda x: x["event"] == n), lambda mine: span(n, mine))))


def parsed(cells: Column, min_pos: int) -> Column:
    """Events of the cells sorted by start, those of one start in the order in which they stand; what is no event is an error."""

    def event(x: Column, p: Column) -> Column:
        start = F.when(p.isNull(), F.raise_error(F.concat(F.lit("no event: "), x["event"])).cast("int")).otherwise(p["start_pos"])
        return F.struct(start.alias("start_pos"), x["ord"].alias("ord"), p["del_len"].alias("del_len"), x["min_target"].alias("min_target"), x["max_target"].alias("max_target"), p["insert_str"].alias("insert_str"))

    return F.array_sort(F.transform(spans(cells), lambda x: let(parse_event(x["event"], -min_pos), lambda p: event(x, p))))


def _event(start: Column, length: Column, lo: Column, hi: Column, inserted: Column) -> Column:
    return F.struct(start.cast("int").alias("start_pos"), length.cast("int").alias("del_len"), lo.cast("int").alias("min_target"), hi.cast("int").alias("max_target"), inserted.alias("insert_str"))


def reassign(e: Column, d: Design) -> Column:
    """The event on targets whose cuts it reaches.  An end that misses its cut moves one target inwards; where none is left the
    nearest cut is taken (of two at one distance that of the end) and the deletion is widened up to it, padded by as many 'a'."""
    n, end = len(d.cuts), e["start_pos"] + e["del_len"]
    lo = e["min_target"] + (e["start_pos"] > _at(d.cuts, e["min_target"])).cast("int")
    hi = e["max_target"] - (end < _at(d.cuts, e["max_target"])).cast("int")
    far = lambda t: F.least(F.abs(e["start_pos"] - _at(d.cuts, t)), F.abs(end - _at(d.cuts, t)))

    def on(target: Column) -> Column:
        return let(_at(d.cuts, target), lambda cut: let(F.least(e["start_pos"], cut), lambda start: widened(target, start, F.greatest(end, cut) - start)))

    def widened(target: Column, start: Column, length: Column) -> Column:
        return _event(start, length, target, target, F.concat(e["insert_str"], F.repeat(F.lit("a"), length - e["del_len"])))

    def moved(x: Column) -> Column:
        lo, hi = x["lo"], x["hi"]
        target = F.when(lo > n - 1, hi).when(hi < 0, 0).when(far(lo) < far(hi), lo).otherwise(hi)
        return F.when(lo > hi, let(target, on)).otherwise(_event(e["start_pos"], e["del_len"], lo, hi, e["insert_str"]))

    return let(F.struct(lo.alias("lo"), hi.alias("hi")), moved)


def dead_from(e: Column, d: Design) -> Column:
    """First target that the event leaves inactive: its neighbour where the deletion reaches the end of its window."""
    return e["min_target"] - F.coalesce((e["start_pos"] <= _at(d.hi, e["min_target"] - 1)) & (e["min_target"] > 0), F.lit(False)).cast("int")


def dead_to(e: Column, d: Design) -> Column:
    return e["max_target"] + F.coalesce(_at(d.lo, e["max_target"] + 1) < e["start_pos"] + e["del_len"], F.lit(False)).cast("int")


def merge_clashes(events: Column, d: Design, threshold: int) -> Column:
    """From left to right an event joins the last one where their targets overlap, or where the last dead target of the one is
    the first of the other and the gap is at most the threshold.  The joined event has both insertions, and one 'a' more
    unless the deletions overlap; its dead targets come from its own ends."""

    def step(done: Column, e: Column) -> Column:
        return let(F.element_at(done, -1), lambda last: joined(done, last, e))

    def joined(done: Column, last: Column, e: Column) -> Column:
        gap = e["start_pos"] - last["start_pos"] - last["del_len"]
        clash = ((dead_to(last, d) == dead_from(e, d)) & (gap <= threshold)) | (last["max_target"] >= e["min_target"])
        inserted = F.concat(last["insert_str"], e["insert_str"], F.when(gap >= 0, "a").otherwise(""))
        both = _event(last["start_pos"], e["start_pos"] - last["start_pos"] + e["del_len"], last["min_target"], F.greatest(last["max_target"], e["max_target"]), inserted)
        return F.when(clash, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(e)))

    def whole(all_: Column) -> Column:
        return F.when(F.size(all_) == 0, all_).otherwise(F.aggregate(F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1))), F.slice(all_, 1, 1), step))

    return let(events.cast(EVENTS), whole)


def clip_overflow(events: Column, d: Design) -> Column:
    """The last event, on the last target, ends with the barcode at most."""

    def whole(all_: Column) -> Column:
        last = F.element_at(all_, -1)
        over = (last["max_target"] == len(d.cuts) - 1) & (last["start_pos"] + last["del_len"] > d.length)
        short = _event(last["start_pos"], d.length - last["start_pos"], last["min_target"], last["max_target"], last["insert_str"])
        return F.when((F.size(all_) > 0) & over, F.concat(F.slice(all_, 1, F.size(all_) - 1), F.array(short))).otherwise(all_)

    return let(events, whole)


def clean(cells: Column, d: Design, min_pos: int = 0, threshold: int = 1) -> Column:
    """Events of a read's target cells: parsed, put on their cut sites, merged where they clash, clipped at the end."""
    on_cuts = F.transform(parsed(cells, min_pos), lambda e: reassign(e, d))
    return clip_overflow(merge_clashes(on_cuts, d, threshold), d)
