"""Line differences between two texts of a row: deleted and inserted lines in order, in hunks.

All of it is array expressions over the lines of one row: no shuffle, and work that grows with the
length of a text and with the square of the number of its stretches that moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.binding import let
from rillway.functions.text import lines_of
from rillway.sources.fields import named

# Fixed value: equal lines shown around a change.
CONTEXT = 3

_FRONTIER = "array<struct<rank:int,kept:int>>"
_CHAINS = "array<struct<first:int,last:int,start:int,n:int,kept:int>>"


def _places(array: Column) -> Column:
    return F.transform(array, lambda _, k: k)


def _opened(array: Column, opens) -> Column:
    """Places of the elements that ``opens(element, the one before)`` says begin a group; the first one does."""
    return F.filter(_places(array), lambda k: (k == 0) | opens(F.get(array, k), F.get(array, k - 1)))


def _grouped(array: Column, opens, use) -> Column:
    """``use(group, where it begins, its number)`` for groups of neighbours, as an array."""
    def groups(starts: Column) -> Column:
        def one(start: Column, number: Column) -> Column:
            end = F.coalesce(F.get(starts, number + 1), F.size(array))
            return let(F.slice(array, start + 1, end - start), lambda group: use(group, start, number))

        return F.transform(starts, one)

    return let(_opened(array, opens), groups)


def _change(i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(name) for c, name in ((i1, "i1"), (i2, "i2"), (j1, "j1"), (j2, "j2"))])


def _differs(change: Column) -> Column:
    return (change["i2"] > change["i1"]) | (change["j2"] > change["j1"])


def _middle(old: Column, new: Column) -> Column:
    """The one stretch between equal beginnings and equal ends."""

    def equal_first(a: Column, b: Column) -> Column:
        same = F.concat(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.array(F.lit(False)))
        return (F.array_position(same, F.lit(False)) - 1).cast("int")

    def between(head: Column) -> Column:
        shorter = F.least(F.size(old), F.size(new)) - head
        tail = F.least(equal_first(F.reverse(old), F.reverse(new)), shorter)
        return let(tail, lambda t: _change(head, F.size(old) - t, head, F.size(new) - t))

    return let(equal_first(old, new), between)


def _pairs(old: Column, new: Column, change: Column, unique: bool) -> Column:
    """Places (j, i) of equal lines of a stretch.

    With ``unique`` only lines that occur once on either side; else the n-th copy goes with the n-th copy.
    Equal lines of both sides meet by sorting.
    """

    def side(lines: Column, begin: Column, end: Column, number: int) -> Column:
        row = lambda x, k: F.struct(x.alias("line"), F.lit(number).alias("side"), (begin + k).alias("at"))
        return F.transform(F.slice(lines, begin + 1, end - begin), row)

    pair = lambda i, j: F.struct(j["at"].alias("j"), i["at"].alias("i"))

    def once(lines: Column) -> Column:
        def only(k: Column) -> Column:
            mine, other = F.get(lines, k), F.get(lines, k + 1)
            sides = (mine["side"] == 0) & (other["side"] == 1) & (mine["line"] == other["line"])
            same = lambda at: F.get(lines, at)["line"].eqNullSafe(mine["line"])
            return F.coalesce(sides, F.lit(False)) & ~same(k - 1) & ~same(k + 2)

        return F.transform(F.filter(_places(lines), only), lambda k: pair(F.get(lines, k), F.get(lines, k + 1)))

    def copies(group: Column, _start: Column, _number: Column) -> Column:
        others = F.filter(group, lambda x: x["side"] == 1)
        return let(
            F.filter(group, lambda x: x["side"] == 0),
            lambda mine: F.transform(F.slice(others, F.lit(1), F.size(mine)), lambda x, k: pair(F.get(mine, k), x)),
        )

    both = F.sort_array(F.concat(side(old, change["i1"], change["i2"], 0), side(new, change["j1"], change["j2"], 1)))
    other_line = lambda x, before: x["line"] != before["line"]
    return let(both, once if unique else lambda lines: F.flatten(_grouped(lines, other_line, copies)))


def _chains(runs: Column) -> Column:
    """Each run with the most lines that can be kept, in order, from it on.

    ``runs`` are in order of the old text, with their ranks in the new one. They are taken from the last to the
    first. The frontier holds, by rank, the most lines of a chain that begins there; it is as long as the longest
    chain of runs.
    """
    start = F.struct(F.array().cast(_FRONTIER).alias("frontier"), F.array().cast(_CHAINS).alias("done"))

    def add(state: Column, run: Column) -> Column:
        def longer(kept: Column) -> Column:
            earlier = F.filter(state["frontier"], lambda f: (f["rank"] < run["first"]) & (f["kept"] > kept))
            later = F.filter(state["frontier"], lambda f: f["rank"] > run["last"])
            entry = F.struct(run["first"].alias("rank"), kept.alias("kept"))
            chain = F.struct(*[run[c].alias(c) for c in ("first", "last", "start", "n")], kept.alias("kept"))
            return F.struct(
                F.concat(earlier, F.array(entry), later).alias("frontier"), F.concat(state["done"], F.array(chain)).alias("done")
            )

        after = F.get(F.filter(state["frontier"], lambda f: f["rank"] > run["last"]), F.lit(0))
        return let((run["n"] + F.coalesce(after["kept"], F.lit(0))).cast("int"), longer)

    return F.aggregate(F.reverse(runs), start, add, lambda state: F.reverse(state["done"]))


def _longest(chains: Column) -> Column:
    """The runs of a longest chain: of equally long ones that which goes on with the earliest run."""
    start = F.struct(
        F.array_max(F.transform(chains, lambda c: c["kept"])).alias("need"), F.lit(-1).alias("rank"), F.array().cast(_CHAINS).alias("taken")
    )

    def take(state: Column, run: Column) -> Column:
        fits = (run["kept"] == state["need"]) & (run["first"] > state["rank"])
        more = F.struct(
            (state["need"] - run["n"]).alias("need"), run["last"].alias("rank"), F.concat(state["taken"], F.array(run)).alias("taken")
        )
        return F.when(fits, more).otherwise(state)

    return F.aggregate(chains, start, take, lambda state: state["taken"])


def _in_order(pairs: Column) -> Column:
    """Of the pairs those of a longest increasing subsequence, in order.

    Pairs that are neighbours on both sides, lines without a partner left out, are one run: it stays
    or moves as a whole, so the search is over runs.
    """
    ranked = F.sort_array(F.transform(F.sort_array(pairs), lambda p, k: F.struct(p["i"].alias("i"), p["j"].alias("j"), k.alias("rank"))))

    def run(group: Column, start: Column, _number: Column) -> Column:
        first, last = F.get(group, F.lit(0)), F.element_at(group, -1)
        return F.struct(first["rank"].alias("first"), last["rank"].alias("last"), start.alias("start"), F.size(group).alias("n"))

    def kept(rows: Column) -> Column:
        runs = _grouped(rows, lambda x, before: x["rank"] != before["rank"] + 1, run)
        chosen = let(_chains(runs), _longest)
        return F.flatten(F.transform(chosen, lambda r: F.slice(rows, r["start"] + 1, r["n"])))

    return let(ranked, kept)


def _refined(old: Column, new: Column, change: Column, unique: bool) -> Column:
    """The stretches that differ within one, once the lines that both of its sides have are aligned."""

    def between(kept: Column) -> Column:
        place = lambda i, j: F.array(F.struct(i.alias("i"), j.alias("j")))
        stops = F.concat(
            place(change["i1"] - 1, change["j1"] - 1),
            F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"))),
            place(change["i2"], change["j2"]),
        )

        def gaps(at: Column) -> Column:
            def gap(k: Column) -> Column:
                a, b = F.get(at, k), F.get(at, k + 1)
                return _change(a["i"] + 1, b["i"], a["j"] + 1, b["j"])

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - 2), gap), _differs)

        return let(stops, gaps)

    cut = lambda lines, begin, end: F.slice(lines, begin + 1, end - begin)
    shared = F.arrays_overlap(cut(old, change["i1"], change["i2"]), cut(new, change["j1"], change["j2"]))
    fine = between(_in_order(_pairs(old, new, change, unique)))
    return F.when(shared, fine).otherwise(F.filter(F.array(change), _differs))


def line_changes(old: Column, new: Column) -> Column:
    """The stretches of two line arrays that differ, in order: lines i1 to i2 of the old became j1 to j2 of the new.

    Lines that occur once on both sides are aligned first, by a longest increasing subsequence. In the stretches
    between them the n-th copy of a line goes with the n-th copy, and those pairs are aligned the same way. Where
    no line repeats this is a longest common subsequence.
    """
    once = let(_middle(old, new), lambda c: _refined(old, new, c, unique=True))
    return F.flatten(F.transform(once, lambda c: _refined(old, new, c, unique=False)))


def _range(first: Column, length: Column) -> Column:
    """Lines as a hunk header gives them: the first one, counted from 1, and their number unless it is one."""
    begin = F.when(length == 0, first).otherwise(first + 1).cast("string")
    return F.when(length == 1, begin).otherwise(F.concat(begin, F.lit(","), length.cast("string")))


def diff_rows(old: Column, new: Column, context: int = CONTEXT) -> Column:
    """All rows of the differences of two line arrays, as an array."""
    none = F.lit("")

    def row(hunk: Column, seq: Column, pos: Column, rule: str, before: Column, after: Column) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"), (hunk + 1).alias("hunk"), pos.cast("int").alias("pos"), F.lit(rule).alias("rule"),
            before.alias("before"), after.alias("after"),
        )

    def hunk(group: Column, _start: Column, number: Column) -> Column:
        def lines(c: Column) -> Column:
            gone, come = F.slice(old, c["i1"] + 1, c["i2"] - c["i1"]), F.slice(new, c["j1"] + 1, c["j2"] - c["j1"])
            return F.concat(
                F.transform(gone, lambda x, k: row(number, c["i1"] + k + c["j1"], c["i1"] + k, "DIFF_DELETE", x, none)),
                F.transform(come, lambda x, k: row(number, c["i2"] + c["j1"] + k, c["j1"] + k, "DIFF_INSERT", none, x)),
            )

        first, last = F.get(group, F.lit(0)), F.element_at(group, -1)
        before = F.least(F.lit(context), first["i1"], first["j1"])
        rest = F.least(F.lit(context), F.size(old) - last["i2"], F.size(new) - last["j2"])
        a, b = first["i1"] - before, first["j1"] - before
        header = F.concat(
            F.lit("@@ -"), _range(a, last["i2"] + rest - a), F.lit(" +"), _range(b, last["j2"] + rest - b), F.lit(" @@")
        )
        return F.concat(F.array(row(number, a + b - 1, a, "HUNK", none, header)), F.flatten(F.transform(group, lines)))

    apart = lambda c, before: c["i1"] - before["i2"] > 2 * context
    return let(line_changes(old, new), lambda changes: F.flatten(_grouped(changes, apart, hunk)))


def line_diff(df: DataFrame, key: str, before: str, after: str, context: int = CONTEXT) -> DataFrame:
    """(key, seq, hunk, pos, rule, before, after, note): what turns one text of a row into the other.

    Rules are HUNK, with the header of a hunk in ``after``, DIFF_DELETE and DIFF_INSERT, with the line and
    its number, from 0, in its own text; a hunk's ``pos`` is its first line in the old text. ``seq`` orders
    the rows of a document: the lines of both sides before them. A line that moved is deleted and inserted.
    Changes with at most twice ``context`` equal lines between them are one hunk. Equal texts give
    no rows; null is an empty text; rows with equal keys are compared each for itself.
    """
    old, new = (F.coalesce(named(c), F.lit("")) for c in (before, after))
    changed = df.filter(old != new)
    rows = let(lines_of(old), lambda a: let(lines_of(new), lambda b: diff_rows(a, b, context)))
    return changed.select(named(key), F.inline(rows)).withColumn("note", F.lit(""))
