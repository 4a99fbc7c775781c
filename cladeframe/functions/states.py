"""Indel sets and ancestral states, as Column expressions.

An indel set is a struct of SET's fields: a wildcard (any indel on targets min_t to max_t; the
first, second and last field null) or a singleton-wildcard (this indel, or anything that it
masks).  A state is an array of them in the order of their targets, which do not overlap; the
unmodified state is empty.  A tract is a struct of TRACT's fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .status import span_mask

SET = "start_pos:int,del_len:int,min_deact:int,min_t:int,max_t:int,max_deact:int,insert_str:string"
STATE = f"array<struct<{SET}>>"
TRACT = "min_deact:int,min_t:int,max_t:int,max_deact:int"
TRACTS = f"array<struct<{TRACT}>>"
_FIELDS = [f.split(":")[0] for f in SET.split(",")]


def observed(events: Column) -> Column:
    """The state of an allele's events (start_pos, del_len, min_deact, min_target, max_target, max_deact, insert_str), in order."""
    names = dict(zip(_FIELDS, ("start_pos", "del_len", "min_deact", "min_target", "max_target", "max_deact", "insert_str")))
    return F.transform(events, lambda e: F.struct(*(e[n].alias(f) for f, n in names.items()))).cast(STATE)


def wildcard(lo: Column, hi: Column) -> Column:
    none = F.lit(None)
    return F.struct(none.cast("int").alias("start_pos"), none.cast("int").alias("del_len"), lo.cast("int").alias("min_deact"), lo.cast("int").alias("min_t"), hi.cast("int").alias("max_t"), hi.cast("int").alias("max_deact"), none.cast("string").alias("insert_str"))


def is_singleton(x: Column) -> Column:
    return x["start_pos"].isNotNull()


def _inner(x: Column) -> tuple[Column, Column]:
    """First and last target of the wildcard inside; the last is before the first where there is none."""
    by = is_singleton(x).cast("int")
    return x["min_t"] + by, x["max_t"] - by


def meet(a: Column, b: Column) -> Column:
    """The intersection of two indel sets, null where it is empty: the same set; the one whose dead targets lie in the other's inner wildcard; the common part of the inner wildcards."""
    (a_lo, a_hi), (b_lo, b_hi) = _inner(a), _inner(b)
    lo, hi = F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)
    both = (a_lo <= a_hi) & (b_lo <= b_hi) & (lo <= hi)
    return F.when(a.eqNullSafe(b), a).when((a_lo <= a_hi) & (a_lo <= b["min_deact"]) & (b["max_deact"] <= a_hi), b).when((b_lo <= b_hi) & (b_lo <= a["min_deact"]) & (a["max_deact"] <= b_hi), a).when(both, wildcard(lo, hi))


def _in_order(found: Column, state: Column) -> Column:
    """found without sets whose long side kills a target on which a short side of state ends, unless that neighbour is in found too."""
    ends = F.transform(F.filter(state, lambda x: x["max_deact"] == x["max_t"]), lambda x: x["max_deact"])
    starts = F.transform(F.filter(state, lambda x: x["min_deact"] == x["min_t"]), lambda x: x["min_deact"])

    def stays(x: Column, k: Column) -> Column:
        before, behind = F.when(k > 0, F.get(found, k - 1)["max_deact"]), F.get(found, k + 1)["min_deact"]
        left = (x["min_t"] != x["min_deact"]) & F.array_contains(ends, x["min_deact"]) & ~before.eqNullSafe(x["min_deact"])
        right = (x["max_t"] != x["max_deact"]) & F.array_contains(starts, x["max_deact"]) & ~behind.eqNullSafe(x["max_deact"])
        return ~(left | right)

    return F.filter(found, stays)


def overlaps(a: Column, b: Column) -> Column:
    """meet() of every two sets whose targets overlap, in the order of targets (sets of a state don't overlap each other)."""
    each = F.transform(a, lambda x: F.filter(F.transform(F.filter(b, lambda y: (y["max_t"] >= x["min_t"]) & (x["max_t"] >= y["min_t"])), lambda y: meet(x, y)), lambda m: m.isNotNull()))
    return F.flatten(each).cast(STATE)


def intersect(a: Column, b: Column) -> Column:
    """The state that both states may come from."""
    return let(overlaps(a, b), lambda found: let(_in_order(found, a), lambda first: _in_order(first, b)))


def text(state: Column) -> Column:
    """'unmod', or the sets joined by '..': lo-hi of a wildcard, the fields of a singleton joined by '_'."""
    def one(x: Column) -> Column:
        return F.when(is_singleton(x), F.concat_ws("_", *(x[f].cast("string") for f in _FIELDS))).otherwise(F.concat_ws("-", x["min_t"].cast("string"), x["max_t"].cast("string")))

    return F.when(F.size(state) == 0, "unmod").otherwise(F.array_join(F.transform(state, one), ".."))


def singletons(state: Column) -> Column:
    return F.filter(state, is_singleton)


def max_status(state: Column) -> Column:
    """Mask of all targets that the state's sets can leave inactive; of singletons(state) for those alone."""
    return F.aggregate(state, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(span_mask(x["min_deact"], x["max_deact"])))


def sub_masks(lo: Column, hi: Column) -> Column:
    """All masks within bits lo to hi, fewest bits first."""
    masks = F.transform(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (hi - lo + 1).cast("int")) - 1), lambda m: F.call_function("shiftleft", m, lo.cast("int")))
    ordered = F.array_sort(F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("n"), m.alias("m"))))
    return F.transform(ordered, lambda x: x["m"])


def possible_statuses(state: Column) -> Column:
    """Masks that the state allows: of every set all sub-masks of its wildcard, or, for a singleton, its whole dead span."""

    def of(x: Column) -> Column:
        lo, hi = _inner(x)
        inside = F.when(lo <= hi, sub_masks(lo, F.greatest(lo, hi))).otherwise(F.array(F.lit(0).cast("long")))
        return F.when(is_singleton(x), F.concat(F.array(span_mask(x["min_deact"], x["max_deact"])), inside)).otherwise(inside)

    start = F.array(F.lit(0).cast("long"))
    return F.array_distinct(F.aggregate(state, start, lambda acc, x: F.flatten(F.transform(acc, lambda m: F.transform(of(x), lambda s: m.bitwiseOR(s))))))


def tract_of(x: Column) -> Column:
    return F.struct(*(x[f].alias(f) for f in ("min_deact", "min_t", "max_t", "max_deact")))


def is_possible(state: Column, tracts: Column) -> Column:
    """Whether the state allows a tuple of tracts: put as sets (the state's singleton with that tract, else a wildcard of its dead targets) they are their own intersection with it."""

    def as_set(t: Column) -> Column:
        own = F.filter(singletons(state), lambda x: tract_of(x) == t)
        return F.when(F.size(own) > 0, F.get(own, 0)).otherwise(wildcard(t["min_deact"], t["max_deact"]))

    return let(F.transform(tracts, as_set).cast(STATE), lambda s: intersect(state, s).eqNullSafe(s))


# -- tuples of tracts ---------------------------------------------------------------
def status_of(tracts: Column) -> Column:
    return F.aggregate(tracts, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(span_mask(x["min_deact"], x["max_deact"])))


def less_or_equal(a: Column, b: Column) -> Column:
    """Whether every tract of a is one of b or strictly inside one, each of b used once, from left to right; tracts of a behind the end of b count as fitting."""
    n = F.size(b)

    def step(acc: Column, t: Column) -> Column:
        ahead = F.filter(F.sequence(acc["at"], F.greatest(acc["at"], n)), lambda k: (k < n) & (F.get(b, k)["max_deact"] >= t["min_deact"]))
        k = F.coalesce(F.get(ahead, 0), n)
        other = F.get(b, k)
        fits = (k >= n) | (other == t) | ((t["min_deact"] > other["min_deact"]) & (t["max_deact"] < other["max_deact"]))
        return F.struct(F.least(k + 1, n).alias("at"), (acc["ok"] & F.coalesce(fits, F.lit(True))).alias("ok"))

    return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), step)["ok"]


def difference(a: Column, b: Column) -> Column:
    """The tracts of b that a has not, where a <= b; else none."""
    return F.when(less_or_equal(a, b), F.array_except(b, a)).otherwise(F.slice(b, 1, 0))


def merged(tracts: Column) -> Column:
    """Tracts of several tuples in the order of their first targets, without those that the one before masks."""
    ordered = F.array_sort(tracts, lambda x, y: F.signum((x["min_t"] - y["min_t"]).cast("double")).cast("int"))

    def step(done: Column, t: Column) -> Column:
        masks = F.coalesce(F.element_at(done, -1)["max_deact"] > t["max_deact"], F.lit(False))
        return F.when((F.size(done) > 0) & masks, done).otherwise(F.concat(done, F.array(t)))

    return F.when(F.size(tracts) == 0, tracts).otherwise(F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.slice(ordered, 1, 1), step))
