"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: a share of the whole by its weight, at most ``most`` times its own size;
what a source cannot take is reshared by weight among the others. Within a source, expected copies e grow with length: in
proportion to LEAN + the bits of a document's size, at most ``most``, so that e times size sums up to the target. Each
document has floor(e) certain whole copies, and a further copy with inclusion probability p = e - floor(e).
Documents are ranked by the Pareto variable (u / (1 - u)) / (p / (1 - p)), u a hash of the id, and the lowest
ranks are taken until their words fill what is left of the target: a sample of fixed size, measured in words.
In the order of ranks a document that would pass the mark is left out, and later ones that still fit fill the room that is
left, over the whole source. If room remains, the smallest document left out is taken where that lands nearer to the mark.

The mark is found without sorting a source in one task: words that still fit are summed per slice of the rank, the slice
that holds the mark is found from these sums, and only its documents and the next BATCH or so are put in order. These fill the room that a
document too large for it leaves; what fits behind them is filled alike, until nothing does. Sources are numbered over ranges, and the level of
their shares is found by sums over them, so that they may be many. From then on they go by number, and a step has two small tables with three
shuffles, as the driver holds a thread for each recent shuffle and broadcast, and plans for each.

Defined results: null text has size 0; null is a source of its own, last; a source without words has target 0; rows of
null id are ranked by their text; rows of one rank go by a hash of their text, so that reruns agree whatever the order of
rows; equal rows follow one another; very long texts count whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import spent, written

SLICE_ROWS, MOST_SLICES, BATCH = 2000, 1 << 20, 4096
#: Expected copies go by this number plus the bits of the size: twice as many for 1,000 words as for one or two.
LEAN = 8


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``rank``, their place in the order of ``key`` from 0, nulls last. Ranges are sorted side by side; only their sizes reach the driver."""
    order = [F.col(key).isNull(), F.col(key)]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("own", F.monotonically_increasing_id()), "ranges")
    part, size = F.shiftright("own", 33).cast("int"), {r[0]: r[1] for r in placed.groupBy(F.shiftright("own", 33)).count().collect()}
    ahead = [sum(n for k, n in size.items() if k < part) for part in range(max(size, default=0) + 1)]
    return placed.withColumn("rank", F.element_at(F.array(*[F.lit(x).cast("long") for x in ahead]), part + 1) + F.col("own").bitwiseAND((1 << 33) - 1)).drop("own")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """From (source, source_size), one row a source: its number ``s`` and its target, capped shares spread by weight over the rest."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = numbered(sizes, "source").withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level, over = 0.0, -1
    while True:  # the level rises with every source that stays below it; as they only become more, this ends soon
        full = F.lit(level) * F.col("weight") > F.col("cap")
        total, taken, free, now = capped.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == over or not free:
            break
        level, over = (float(total) * share - (taken or 0.0)) / free, now
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if free else F.col("cap")
    return capped.select(*sizes.columns, F.col("rank").alias("s"), target.alias("target"))


def plan_of(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """From (source, size): for each source, its number ``s``, and the ``bits`` of its sizes, the certain copies and the odds of one more; and the room of the source for these, once (``lead``)."""
    bits = rows.groupBy("source", F.length(F.bin("size")).alias("bits")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    bits = written(bits, "bits")
    sums = bits.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("source_rows"))
    aimed = targets(sums, weights, share, most).withColumnsRenamed({"source": "named"})
    lean = F.col("bits") + F.lit(LEAN)
    own = bits.join(aimed, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # the longest texts are the first to reach the cap; the level is set by the first that does not
    all_of = Window.partitionBy("s")
    order = all_of.orderBy(F.col("bits").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("target") - F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(float(most))) / F.sum(lean * F.col("words")).over(after)
    own = own.withColumn("level", F.when(F.sum(lean * F.col("words")).over(after) > 0, level))
    found = F.max(F.when(F.col("level") * lean <= most, F.col("level"))).over(all_of)
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(found * lean, F.lit(float(most))))).otherwise(F.lit(0.0))
    own = own.withColumn("expected", expected).withColumn("certain", F.floor("expected").cast("long"))
    own = own.withColumn("odds", (F.col("expected") - F.col("certain")) / (F.lit(1.0) - (F.col("expected") - F.col("certain"))))
    room = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(all_of)
    lead = (F.row_number().over(order) == 1) & (F.max("odds").over(all_of) > 0)
    slices = F.least(F.floor(F.col("source_rows") / SLICE_ROWS) + 1, F.lit(MOST_SLICES))
    out = written(own.select("source", "s", "bits", "source_size", "target", "expected", "certain", "odds", room.alias("room"), lead.alias("lead"), slices.alias("slices")), "targets")
    spent(bits)
    return out


def _fits() -> F.Column:
    """Of documents that meet a state of their source: those that fit its ``room`` and lie behind ``after`` (null: all do)."""
    return (F.col("size") <= F.col("room")) & (F.col("after").isNull() | (F.col("at") > F.col("after")))


def _step(ranked: DataFrame, state: DataFrame, batch: int) -> DataFrame:
    """One row for each row of ``state`` (s, room, after): what fits is taken ahead of ``before`` (null: to the end), and of the next ``batch`` documents or so the ``rows``, in order,
    each if there is room for it; then ``left`` is over, and ``more`` says if documents may lie behind ``last``.
    """
    live = ranked.join(state, "s").filter(_fits()).select("s", "slice", "size", F.lit(1).alias("n"), "room", "after")
    none = state.select("s", F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), "room", "after")  # a source where nothing fits stays
    sums = live.unionByName(none).groupBy("s", "slice").agg(F.sum("size").alias("words"), F.sum("n").alias("n"), F.first("room").alias("room"), F.first("after").alias("after"))
    all_of = Window.partitionBy("s")
    ahead = all_of.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumns({"ahead": F.coalesce(F.sum("words").over(ahead), F.lit(0)), "docs": F.coalesce(F.sum("n").over(ahead), F.lit(0))})
    # the one slice of each source where the mark is passed, and those behind it that make up a batch
    placed = placed.withColumn("edge", F.min(F.when(F.col("ahead") + F.col("words") > F.col("room"), F.struct("slice", "ahead", "docs"))).over(all_of))
    near = (F.col("slice") >= F.col("edge.slice")) & (F.col("docs") - F.col("edge.docs") < batch)
    ends = placed.groupBy("s").agg(F.first("room").alias("room"), F.first("after").alias("after"), F.first("edge.slice").alias("low"), F.first("edge.ahead").alias("ahead"), F.max(F.when(near, F.col("slice"))).alias("high"), F.max("slice").alias("end"), F.sum("words").alias("fit"))
    ends = written(ends, "mix-marks")
    inside = ranked.join(ends.filter("low is not null"), "s").filter(_fits() & F.col("slice").between(F.col("low"), F.col("high"))).select(*ends.columns, "at", "size")
    inside = inside.unionByName(ends.filter("low is null"), allowMissingColumns=True)
    upto = all_of.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("took", F.col("ahead") + F.sum("size").over(upto))
    inside = inside.withColumn("k", F.count_if(F.col("took") > F.col("room")).over(upto))  # 0 up to the mark, then counted
    behind = F.when(F.col("k").between(1, batch), F.struct("at", "size"))
    same = [F.first(c).alias(c) for c in ("room", "after", "fit", "high", "end")]
    got = inside.groupBy("s").agg(*same, F.sort_array(F.collect_list(behind)).alias("behind"), F.min(F.when(F.col("k") > 0, F.struct("at", (F.col("took") - F.col("size")).alias("took")))).alias("first"), F.max("k").alias("k"))
    start = F.struct((F.col("room") - F.coalesce("first.took", "fit")).alias("room"), F.array().cast("array<bigint>").alias("rows"))
    fill = lambda a, x: F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.array_append(a["rows"], x["at"]["row"]).alias("rows"))).otherwise(a)
    got = got.withColumn("done", F.aggregate("behind", start, fill))
    more = F.coalesce((F.col("high") < F.col("end")) | (F.col("k") >= batch), F.lit(False)) & (F.col("done.room") > 0)
    out = written(got.select("s", "room", "after", F.col("first.at").alias("before"), F.col("done.rows").alias("rows"), F.col("done.room").alias("left"), F.get("behind", F.size("behind") - 1)["at"].alias("last"), more.alias("more")), "mix-step")
    spent(ends)
    return out


def _taken(ranked: DataFrame, state: DataFrame, batch: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The documents (row) that fill each source's room in their order, each if it fits what is left; the room left at the end (s, room); and the tables that this rests on."""
    steps = []
    while not steps or not state.isEmpty():
        steps.append(_step(ranked, state, batch))
        state = steps[-1].filter("more").select("s", F.col("left").alias("room"), F.col("last").alias("after"))
    step = reduce(DataFrame.unionByName, steps)
    ahead = ranked.join(step.drop("rows"), "s").filter(_fits() & (F.col("before").isNull() | (F.col("at") < F.col("before")))).select("row")
    chosen = written(ahead.unionByName(step.select(F.explode("rows").alias("row"))), "chosen")
    return chosen, step.filter("not more").select("s", F.col("left").alias("room")), steps


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, batch: int = BATCH) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (whole copies that the mix takes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.md5(text).alias("tie"), F.monotonically_increasing_id().alias("row")), "sizes")
    # The plan stays a small side: a row for each source and length class, which Spark broadcasts only below its own threshold.
    plan = plan_of(rows, weights, share, most)
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.col("tie")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    rank = u / (F.lit(1.0) - u) / F.col("odds")
    named = plan.filter("odds > 0").select("s", F.col("source").alias("named"), F.col("bits").alias("b"), "slices", "odds")
    ranked = rows.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("named")) & (F.length(F.bin("size")) == F.col("b"))).withColumn("rank", rank)
    slice_of = F.floor(F.col("rank") / (F.col("rank") + 1.0) * F.col("slices")).cast("int")  # grows with the rank
    ranked = written(ranked.select("s", "row", "size", slice_of.alias("slice"), F.struct("rank", "tie", "row").alias("at")), "ranked")
    state = plan.filter("lead and room > 0").select("s", "room", F.lit(None).cast(ranked.schema["at"].dataType).alias("after"))
    chosen, ends, steps = _taken(ranked, state, batch)
    # what was left out is larger than the room that is left, if any is: the smallest of it may still land nearer
    over = ranked.join(ends, "s").filter((F.col("room") > 0) & (F.col("size") > F.col("room")) & (F.col("size") < 2 * F.col("room")))
    over = over.join(chosen.select(F.col("row").alias("had")), F.col("row") == F.col("had"), "left_anti").groupBy("s").agg(F.min(F.struct("size", "at")).alias("least"))
    extra = chosen.select("row").unionByName(over.select(F.col("least.at.row").alias("row"))).select(F.col("row").alias("r"), F.lit(1).cast("long").alias("extra"))
    own = plan.withColumnsRenamed({"source": "named", "bits": "b"})
    out = rows.join(own, F.col("source").eqNullSafe(F.col("named")) & (F.length(F.bin("size")) == F.col("b"))).join(extra, F.col("row") == F.col("r"), "left")
    out = written(out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("certain") + F.coalesce("extra", F.lit(0))).alias("copies")), "mixed")
    spent(rows, ranked, chosen, *steps)
    return out
