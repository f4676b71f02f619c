"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T words and size S words wants T / S copies of each of
its documents.  The whole part is the same for all; the fractions are rounded
to 0 or 1 together: a document is paired with all smaller ones, and the two
sides pass mass (counted in words) at random, unbiased, until one of them is
integral.  Mostly that is the document; the smaller ones have each given or
taken in proportion, and the largest of them is next.  (Where all the smaller
ones together could not make up for one outcome, it is the other.)  So the words of a source
stay the same through every step, long documents are settled while there are
many others to make up for them, and what is left of a source at last is a
short one.  Only that is rounded on its own, to the nearer side: the words
taken are off the target by half of it at most.

The pairing is a reduction tree for each class of sizes.  Documents of a source
and class are dealt by hash into groups of about ``GROUP``; a group is folded to
one fractional document, these are folded in groups again, until one is left,
which goes to the class below.  No group grows with its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefloom.functions.text import let
from hrefloom.llm.common import Stages, text_of, words_of
from hrefloom.operators.numbering import global_rank

GROUP = 128
# sizes of a class differ by this factor at most
CLASS = 8
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
# copies nearer than this to a whole number are whole
WHOLE = 1e-9

_ITEM = "struct<k:bigint,p:double,s:double>"
_DONE = "array<struct<k:bigint,c:int>>"


def _step(draw: str) -> str:
    """SQL of one pairing: item ``x`` with all that follow it.

    Fractions of the items that follow are ``a * p + b``: a side that gives a
    share f of its mass is left with (1 - f) of each fraction, one that takes a
    share f of its room with f more and (1 - f) of each.  ``acc`` holds a and b,
    and the words of what follows, plain and times p.
    """
    state = lambda a, b, rest, c: (
        f"named_struct('a', {a}, 'b', {b}, 's', m.s, 'w', m.w, 'rest', {rest},"
        f" 'done', {f'concat(acc.done, array(named_struct({chr(39)}k{chr(39)}, x.k, {chr(39)}c{chr(39)}, {c})))' if c is not None else 'acc.done'})"
    )
    item = lambda p: f"cast(named_struct('k', x.k, 'p', least(1D, greatest(0D, {p})), 's', x.s) as {_ITEM})"
    u = f"(pmod(xxhash64(x.k, '{draw}'), {1 << 52}L) / {float(1 << 52)!r}D)"
    given, taken = "(v.up / v.mass)", "(v.down / v.room)"
    grow = (
        f"if((1 - m.p) * x.s <= v.mass, {state(f'acc.a * (1 - {given})', f'acc.b * (1 - {given})', 'acc.rest', '1')},"
        f" {state('0D', '0D', item('m.p + v.up / x.s'), None)})"
    )
    shrink = (
        f"if(m.p * x.s <= v.room, {state(f'acc.a * (1 - {taken})', f'{taken} + acc.b * (1 - {taken})', 'acc.rest', '0')},"
        f" {state('0D', '1D', item('m.p - v.down / x.s'), None)})"
    )
    paired = let(
        "named_struct('mass', m.mass, 'room', m.room, 'up', least((1 - m.p) * x.s, m.mass), 'down', least(m.p * x.s, m.room))", "v",
        # an item too long for what follows to make up for goes the way that they can
        f"if(if((1 - m.p) * x.s <= v.mass AND m.p * x.s > v.room, true, if((1 - m.p) * x.s > v.mass AND m.p * x.s <= v.room, false,"
        f" {u} * (v.up + v.down) < v.down)), {grow}, {shrink})",
    )
    whole = state("acc.a", "acc.b", "acc.rest", "if(m.p > 0.5D, 1, 0)")
    alone = state("acc.a", "acc.b", item("m.p"), None)
    own = "least(1D, greatest(0D, acc.a * x.p + acc.b))"
    left = "named_struct('p', {0}, 's', acc.s - x.s, 'w', acc.w - x.p * x.s)".format(own)
    sides = "named_struct('p', q.p, 's', q.s, 'w', q.w, 'mass', greatest(0D, acc.a * q.w + acc.b * q.s), 'room', greatest(0D, q.s - acc.a * q.w - acc.b * q.s))"
    step = f"if(m.p <= {WHOLE} OR m.p >= {1 - WHOLE!r}, {whole}, if(m.s < 0.5D OR m.mass + m.room <= 0D, {alone}, {paired}))"
    return let(left, "q", let(sides, "m", step))


def fold_group(items: str, draw: str = "") -> str:
    """SQL: an array of fractional items, largest first -> ``struct<rest, done>``; at most one is left."""
    zero = (
        f"named_struct('a', 1D, 'b', 0D, 's', aggregate({items}, 0D, (t, x) -> t + x.s), 'w', aggregate({items}, 0D, (t, x) -> t + x.p * x.s),"
        f" 'rest', cast(null as {_ITEM}), 'done', cast(array() as {_DONE}))"
    )
    return f"aggregate({items}, {zero}, (acc, x) -> {_step(draw)}, acc -> named_struct('rest', acc.rest, 'done', acc.done))"


def _tree(items: DataFrame, stages: Stages, group: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """``stratum, k, p, s`` -> the item that each stratum is left with, at most one, and ``k, c`` of the others."""
    sizes = items.groupBy("stratum").agg(F.count("*").alias("n"))
    sizes = stages.write(f"{name}-strata", sizes.withColumn("groups", F.ceil(F.col("n") / group).cast("bigint")))
    same = items["stratum"].eqNullSafe(sizes["stratum"])
    level = (
        items.join(sizes, same)
        .withColumn("g", F.pmod(F.xxhash64("k", F.lit("group")), F.col("groups")))
        .select(items["stratum"], "g", "k", "p", "s")
    )
    most = sizes.agg(F.max("groups")).first()[0] or 0
    decided, depth = [], 0
    while True:
        one = F.struct((-F.col("s")).alias("shorter"), F.xxhash64("k", F.lit(depth)).alias("h"), "k", "p", "s")
        folded = level.groupBy("stratum", "g").agg(F.sort_array(F.collect_list(one)).alias("items"))
        # an item that goes on is drawn for again, by other numbers
        folded = stages.write(f"{name}-{depth}", folded.select("stratum", "g", F.expr(fold_group("items", f"{name}-{depth}")).alias("f")))
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.k", "d.c"))
        rest = folded.where("f.rest IS NOT NULL").select("stratum", F.floor(F.col("g") / group).cast("bigint").alias("g"), "f.rest.*")
        if most <= 1:
            return rest.select("stratum", "k", "p", "s"), decided
        level, most, depth = rest, -(-most // group), depth + 1


def pivotal_round(items: DataFrame, stages: Stages, group: int = GROUP) -> DataFrame:
    """``stratum, k, p, s`` -> ``k, c``: each k gets 0 or 1, with E[c] = p but for the last one of a stratum.

    ``k`` is unique and not null, 0 < p < 1, s >= 1.  The sum of c * s over a
    stratum is that of p * s, but for the last item left there; an item that is
    longer than what its whole group could make up for one way goes the other.  Sizes are
    folded by classes (powers of ``CLASS``), the largest first, and what a class
    is left with joins the next: so a group holds enough to make up for its
    longest item, and the last item is of the shortest class.  An empty table
    gives an empty table.  The same rows give the same result.
    """
    classed = items.withColumn("class", F.floor(F.log(float(CLASS), "s") + WHOLE).cast("int"))
    classes = sorted((r["class"] for r in classed.select("class").distinct().collect()), reverse=True)
    decided: list[DataFrame] = []
    left = None
    for size in classes:
        own = classed.where(F.col("class") == size).select("stratum", "k", "p", "s")
        left, done = _tree(own if left is None else own.unionByName(left), stages, group, f"class-{size}")
        decided += done
    if left is None:
        return items.select("k", F.lit(0).alias("c"))
    last = left.select("k", (F.col("p") >= 0.5).cast("int").alias("c"))
    for d in decided:
        last = last.unionByName(d)
    return last


def source_targets(sizes: DataFrame, stages: Stages) -> DataFrame:
    """``source, source_size`` -> ``+ target``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all
    words by weight.  No target exceeds three times its source; what is over is
    shared again by weight among the others, until none is above.
    """
    keyed = sizes.select("source", "source_size", F.col("source").isNull().alias("_null"))
    ranked = global_rank(keyed, ["_null", "source"], "rank", stages.root)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, len(WEIGHTS)) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST_COPIES)).alias("cap"))
    weighed = stages.write("weighed", weighed)
    share, above = 0.0, -1
    while True:
        full = F.col("w") * share > F.col("cap")
        got = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.sum(full.cast("int")),
        ).first()
        if got[0] is None or not got[2] or got[3] == above:
            break
        above, share = got[3], (got[0] - got[1]) / got[2]
    target = F.least(F.col("w") * share, F.col("cap"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, stages: Stages) -> DataFrame:
    """``doc_id, text, source`` -> ``row_key, doc_id, size, source_size, target, copies``, a row per row.

    ``size`` is the number of words.  Rows that agree in id, source and text
    are one item: they get the same number of copies.  Texts without words get
    no fraction, only the whole part.  Null ids, sources and texts are values
    like others.  Only these narrow columns are shuffled.
    """
    narrow = docs.select(
        F.xxhash64("doc_id", "source", text_of()).alias("row_key"), "doc_id", "source",
        F.size(words_of(text_of())).cast("bigint").alias("size"),
    )
    narrow = stages.write("sizes", narrow)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stages.write("targets", source_targets(sizes, stages))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate + WHOLE)).withColumn("part", rate - F.col("whole"))
    items = narrow.where("size > 0").groupBy("row_key").agg(F.min("source").alias("source"), F.sum("size").cast("double").alias("s"))
    parts = targets.where(F.col("part") > WHOLE).select(F.col("source").alias("stratum"), F.col("part").alias("p"))
    items = items.join(parts, F.col("source").eqNullSafe(F.col("stratum"))).select("stratum", F.col("row_key").alias("k"), "p", "s")
    rounded = pivotal_round(items, stages).select(F.col("k").alias("row_key"), "c")
    by_source = targets.select(F.col("source").alias("_source"), "source_size", "target", "whole")
    all_rows = narrow.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).join(rounded, "row_key", "left")
    copies = (F.col("whole") + F.coalesce("c", F.lit(0))).cast("bigint")
    return all_rows.select("row_key", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, stages: Stages) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    plan = mix_sources(docs, stages).where("copies > 0").select(F.col("row_key").alias("_row_key"), F.col("copies").cast("int").alias("_copies"))
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "source", text_of()))
    taken = keyed.join(plan.distinct(), "_row_key")
    again = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return taken.select(*docs.columns, again).drop("_copy")
